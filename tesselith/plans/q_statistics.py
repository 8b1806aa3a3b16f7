"""Queries: information measures, ranks, resampling, exact tests, term weights."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import features as V
from tesselith.operators import measures as M
from tesselith.operators import passages as O
from tesselith.operators import pools as L
from tesselith.operators import resample as R
from tesselith.plans import sqltext as S
from tesselith.plans.sizing import small

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_U = """c AS (SELECT {0} g, silver l, count(*) n FROM p WHERE {0} IS NOT NULL AND silver IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) t FROM c), hl AS (SELECT -sum(p * ln(p)) h FROM (SELECT sum(n) * 1.0 / (SELECT t FROM t) p FROM c GROUP BY l)),
hc AS (SELECT -sum(n * 1.0 / (SELECT t FROM t) * ln(n * 1.0 / gn)) h FROM (SELECT n, sum(n) OVER (PARTITION BY g) gn FROM c))"""


@query(f"WITH {S.PASSAGES}, c AS (SELECT grp, silver, count(*) n FROM p WHERE silver IS NOT NULL GROUP BY 1, 2) SELECT grp, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS h FROM c GROUP BY 1")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    c = O.passages(spark, d, "silver").where("silver is not null").groupBy("grp", "silver").agg(F.count("*").alias("n"))
    return c.groupBy("grp").agg(F.round(M.entropy(F.col("n")), 8).alias("h"))


@query(f"WITH {S.PASSAGES}, {_U.format('doc_id')} SELECT round(hl.h, 8) AS h_label, round(hc.h, 8) AS h_given, round(CASE WHEN hl.h = 0 THEN 0 ELSE (hl.h - hc.h) / hl.h END, 8) AS u FROM hl, hc")
def theil_u(spark: SparkSession, d: str) -> DataFrame:
    return M.theil_u(O.passages(spark, d, "doc_id", "silver"), "doc_id", "silver").select(*[F.round(c, 8).alias(c) for c in ("h_label", "h_given", "u")])


@query(f"WITH {S.PASSAGES}, {_U.format('grp')} SELECT round(hl.h, 8) AS h_label, round(hc.h, 8) AS h_given, round(CASE WHEN hl.h = 0 THEN 0 ELSE (hl.h - hc.h) / hl.h END, 8) AS u FROM hl, hc")
def theil_u_group(spark: SparkSession, d: str) -> DataFrame:
    return M.theil_u(O.passages(spark, d, "silver"), "grp", "silver").select(*[F.round(c, 8).alias(c) for c in ("h_label", "h_given", "u")])


_VOC = "(VALUES " + ", ".join(f"('{x}')" for x in P.LABELS) + ") v(label)"
_DIST = f"""{S.PASSAGES}, c AS (SELECT domain, grp, silver AS label, count(*) n FROM p WHERE domain IS NOT NULL AND silver IN (SELECT label FROM {_VOC}) GROUP BY 1, 2, 3),
g AS (SELECT * FROM (SELECT DISTINCT domain, grp FROM c), {_VOC}), q AS (SELECT domain, grp, label, (coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY domain, grp) q FROM g LEFT JOIN c USING (domain, grp, label))"""


@query(f"WITH {_DIST} SELECT domain, grp, label, round(q, 8) AS q FROM q")
def smoothed_distributions(spark: SparkSession, d: str) -> DataFrame:
    return _dist(spark, d).withColumn("q", F.round("q", 8))


def _dist(spark: SparkSession, d: str) -> DataFrame:
    return M.smoothed(O.passages(spark, d, "domain", "silver").where("domain is not null"), ["domain", "grp"], "silver", list(P.LABELS))


@query(f"WITH {_DIST} SELECT x.domain, x.grp AS a, y.grp AS b, round(sum(0.5 * x.q * log2(x.q / ((x.q + y.q) / 2)) + 0.5 * y.q * log2(y.q / ((x.q + y.q) / 2))), 8) AS jsd FROM q x JOIN q y ON x.domain = y.domain AND x.label = y.label AND x.grp < y.grp GROUP BY 1, 2, 3")
def jsd_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.jsd(_dist(spark, d), "grp", "domain").withColumn("jsd", F.round("jsd", 8))


_CELLS = f"{S.PASSAGES}, c AS (SELECT grp, avg((modality[1] = 'MUST_NOT')::INT) FILTER (WHERE domain = 'criminal') - avg((modality[1] = 'MUST_NOT')::INT) FILTER (WHERE domain = 'civil') AS diff, count(DISTINCT doc_id) AS docs FROM p GROUP BY 1)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Share of prohibitions, criminal less civil, by group."""
    hit = (F.get("modality", F.lit(0)) == "MUST_NOT").cast("int")
    rate = lambda x: F.avg(F.when(F.col("domain") == x, hit))
    return O.passages(spark, d, "domain", "modality", "doc_id").groupBy("grp").agg((rate("criminal") - rate("civil")).alias("diff"), F.count_distinct("doc_id").alias("docs"))


def _half(first: bool) -> str:
    """Sums of all sign patterns of one half of the groups."""
    size, bit, which = ("n // 2", "j", "j < n // 2") if first else ("n - n // 2", "(j - n // 2)", "j >= n // 2")
    return f"(SELECT i, coalesce(sum(CASE WHEN (i >> {bit}) & 1 = 1 THEN diff ELSE -diff END), 0) t FROM (SELECT unnest(range((1::BIGINT << ({size}))::BIGINT)) i FROM o) LEFT JOIN (SELECT diff, j::BIGINT j, n FROM k, o WHERE {which}) ON true GROUP BY 1)"


@query(f"""WITH {_CELLS}, k AS (SELECT diff, row_number() OVER (ORDER BY grp) - 1 AS j FROM c WHERE diff IS NOT NULL), o AS (SELECT sum(diff) s, count(*) n FROM k), x AS {_half(True)}, y AS {_half(False)},
e AS (SELECT count(*) m FROM x, y, o WHERE abs(x.t + y.t) >= abs(s) - 1e-12) SELECT n, round(s / n, 8) AS mean, m AS n_extreme, round(greatest(m, 2) / (2.0 ** n), 8) AS p FROM o, e""")  # fmt: skip
def signflip_exact(spark: SparkSession, d: str) -> DataFrame:
    """All sign patterns of all groups that have both rates, from the sums of two halves."""
    return R.sign_flip_halves(_cells(spark, d), "grp", "diff").select("n", F.round("mean", 8).alias("mean"), "n_extreme", F.round("p", 8).alias("p"))


@query(f"""WITH {_CELLS}, k AS (SELECT grp, diff FROM c WHERE diff IS NOT NULL), s AS (SELECT rep, sum(CASE WHEN substr(md5(concat_ws('|', 'f1', rep, grp)), 1, 1) < '8' THEN diff ELSE -diff END) t FROM k, (SELECT unnest(range(20000)) rep) GROUP BY 1), o AS (SELECT sum(diff) s, count(*) n FROM k)
SELECT n, round(s / n, 8) AS mean, round((1 + (SELECT count(*) FROM s, o WHERE abs(t) >= abs(s) - 1e-12)) / 20001.0, 8) AS p FROM o""")  # fmt: skip
def signflip_mc(spark: SparkSession, d: str) -> DataFrame:
    return R.sign_flip(_cells(spark, d), "grp", "diff", 20000, "f1").select("n", F.round("mean", 8).alias("mean"), F.round("p", 8).alias("p"))


@query(f"""WITH {_CELLS}, k AS (SELECT grp, diff, docs FROM c WHERE diff IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY diff) + (count(*) OVER (PARTITION BY diff) - 1) / 2.0 a, rank() OVER (ORDER BY docs) + (count(*) OVER (PARTITION BY docs) - 1) / 2.0 b FROM k)
SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM r""")  # fmt: skip
def spearman(spark: SparkSession, d: str) -> DataFrame:
    r = M.average_ranks(M.average_ranks(_cells(spark, d).where("diff is not null"), "diff", "a"), "docs", "b")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 8).alias("rho"))


@query(f"""WITH {_CELLS}, k AS (SELECT grp, diff, docs FROM c WHERE diff IS NOT NULL), r AS (SELECT x.grp out, rank() OVER (PARTITION BY x.grp ORDER BY k.diff) + (count(*) OVER (PARTITION BY x.grp, k.diff) - 1) / 2.0 a, rank() OVER (PARTITION BY x.grp ORDER BY k.docs) + (count(*) OVER (PARTITION BY x.grp, k.docs) - 1) / 2.0 b FROM k JOIN k x ON x.grp <> k.grp)
SELECT out AS left_out, round(corr(a, b), 8) AS rho FROM r GROUP BY 1""")  # fmt: skip
def leave_one_out_rho(spark: SparkSession, d: str) -> DataFrame:
    k = _cells(spark, d).where("diff is not null")
    rows = k.join(small(k.select(F.col("grp").alias("left_out"))), F.col("grp") != F.col("left_out"))  # one row a group
    r = rows.select("left_out", M.average_rank("diff", "left_out").alias("a"), M.average_rank("docs", "left_out").alias("b"))
    return r.groupBy("left_out").agg(F.round(F.corr("a", "b"), 8).alias("rho"))


@query(f"WITH {S.PASSAGES}, g AS (SELECT grp, count(*) n, count(DISTINCT doc_id) m FROM p GROUP BY 1) SELECT round(regr_slope(ln(n), ln(m)), 8) AS slope, count(*) AS n_groups FROM g")
def loglog_slope(spark: SparkSession, d: str) -> DataFrame:
    g = O.passages(spark, d, "doc_id").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("m"))
    return g.agg(F.round(F.regr_slope(F.log("n"), F.log("m")), 8).alias("slope"), F.count("*").alias("n_groups"))


_BOOT = f"""{S.PASSAGES}, c AS (SELECT grp, gold t, nli_label p, count(*) n FROM p WHERE gold IS NOT NULL AND nli_label IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', 'b1', grp)), grp) - 1 j FROM (SELECT DISTINCT grp FROM c)), z AS (SELECT count(*) z FROM k),
dr AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'b1', rep, k.j)), 1, 12))::BIGINT % z j FROM (SELECT unnest(range(2000)) rep), k, z), m AS (SELECT rep, j, count(*) m FROM dr GROUP BY 1, 2),
w AS (SELECT rep, t, p, sum(n * m) n FROM m JOIN k USING (j) JOIN c USING (grp) GROUP BY 1, 2, 3),
e AS (SELECT rep, v, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT rep, t v, CASE WHEN t = p THEN n ELSE 0 END tp, 0 fp, CASE WHEN t <> p THEN n ELSE 0 END fn FROM w UNION ALL SELECT rep, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM w) GROUP BY 1, 2),
f AS (SELECT rep, avg(2.0 * tp / (2 * tp + fp + fn)) macro_f1 FROM e GROUP BY 1)"""


@query(f"WITH {_BOOT} SELECT rep, round(macro_f1, 8) AS macro_f1 FROM f")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _boot(spark, d).select("rep", F.round("macro_f1", 8).alias("macro_f1"))


def _boot(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_bootstrap(O.passages(spark, d, "gold", "nli_label"), "grp", "gold", "nli_label", 2000, "b1")


@query(f"WITH {_BOOT} SELECT round(quantile_cont(macro_f1, 0.025), 8) AS low, round(quantile_cont(macro_f1, 0.5), 8) AS mid, round(quantile_cont(macro_f1, 0.975), 8) AS high FROM f")
def quantile_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.interval(_boot(spark, d), "macro_f1").select(*[F.round(c, 8).alias(c) for c in ("low", "mid", "high")])


_FISH = f"{S.PASSAGES}, g AS (SELECT count_if(domain = 'civil' AND ocr)::BIGINT a, count_if(domain = 'civil' AND NOT ocr)::BIGINT b, count_if(domain = 'criminal' AND ocr)::BIGINT c, count_if(domain = 'criminal' AND NOT ocr)::BIGINT d FROM p)"


@query(f"""WITH {_FISH}, x AS (SELECT *, unnest(range(greatest(0, (a + c) - (c + d)), least(a + b, a + c) + 1)) x FROM g), lf AS (SELECT a, b, c, d, x, lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-a-c+x+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) lp FROM x),
l0 AS (SELECT lp l0 FROM lf WHERE x = a) SELECT a, b, c, d, round(a * d * 1.0 / (b * c), 6) AS odds_ratio, round(least(1.0, sum(CASE WHEN lp <= l0 + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM lf, l0 GROUP BY a, b, c, d""")  # fmt: skip
def fisher(spark: SparkSession, d: str) -> DataFrame:
    is_, civ = F.col("ocr"), F.col("domain") == "civil"
    crim = F.col("domain") == "criminal"
    t = O.passages(spark, d, "domain", "ocr").agg(F.count_if(civ & is_).alias("a"), F.count_if(civ & ~is_).alias("b"), F.count_if(crim & is_).alias("c"), F.count_if(crim & ~is_).alias("d"))
    return R.fisher(t).select("a", "b", "c", "d", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 6).alias("p"))


@query(f"""WITH {S.PASSAGES}, g AS (SELECT count_if(rule_label = gold AND nli_label <> gold)::BIGINT a, count_if(rule_label <> gold AND nli_label = gold)::BIGINT b FROM p WHERE gold IS NOT NULL AND rule_label IS NOT NULL AND nli_label IS NOT NULL), x AS (SELECT a, b, unnest(range(0, least(a, b) + 1)) i FROM g)
SELECT a::BIGINT AS only_one, b::BIGINT AS only_two, round(least(1.0, 2 * sum(exp(lgamma(a+b+1) - lgamma(i+1) - lgamma(a+b-i+1) - (a+b) * ln(2.0)))), 6) AS p FROM x GROUP BY a, b""")  # fmt: skip
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return R.mcnemar(O.passages(spark, d, "gold", "rule_label", "nli_label"), "gold", "rule_label", "nli_label").withColumn("p", F.round("p", 6))


_TOK = "[a-z][a-z''-]+"
_ODDS = f"""{S.PASSAGES}, t AS (SELECT grp, unnest(regexp_extract_all(lower(text), '{_TOK}')) w FROM p WHERE text IS NOT NULL), c AS (SELECT grp, w, count(*) n FROM t GROUP BY 1, 2), k AS (SELECT w, sum(n) nt FROM c GROUP BY 1 HAVING sum(n) >= 5), g AS (SELECT grp, sum(n) ng FROM c GROUP BY 1), a AS (SELECT sum(n) na FROM c),
z AS (SELECT grp, w, n, (ln((n + 500.0 * nt / na) / (ng + 500.0 - n - 500.0 * nt / na)) - ln((nt - n + 500.0 * nt / na) / (na - ng + 500.0 - (nt - n) - 500.0 * nt / na))) / sqrt(1 / (n + 500.0 * nt / na) + 1 / (nt - n + 500.0 * nt / na)) z FROM c JOIN k USING (w) JOIN g USING (grp), a)"""


@query(f"WITH {_ODDS} SELECT grp, w AS term, n, round(z, 6) AS z FROM z QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(z, 9) DESC, w DESC) <= 10")
def log_odds_terms(spark: SparkSession, d: str) -> DataFrame:
    z = M.log_odds(V.term_counts(O.passages(spark, d, "text"), "grp", "text", "[a-z][a-z'-]+"), "grp", "term")
    return V.top_per_group(z.withColumn("_z", F.round("z", 9)), "grp", [F.desc("_z"), F.desc("term")], 10).select("grp", "term", "n", F.round("z", 6).alias("z"))


_DOCS = f"""{S.PASSAGES}, d AS (SELECT provision_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}') w FROM p), g AS (SELECT provision_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) term FROM d),
c AS (SELECT provision_id, term, count(*) tf FROM g GROUP BY 1, 2), k AS (SELECT term, count(*) df FROM c GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) n FROM d),
x AS (SELECT provision_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) w FROM c JOIN k USING (term), n)"""


@query(f"WITH {_DOCS}, s AS (SELECT provision_id, sqrt(sum(w * w)) norm, count(*) m FROM x GROUP BY 1) SELECT provision_id, m AS n_terms, round(norm, 6) AS norm, round((SELECT max(w) FROM x WHERE x.provision_id = s.provision_id) / norm, 6) AS top_weight FROM s")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Number of terms, length before scaling, and largest weight of every passage's vector."""
    w = V.tfidf(O.passages(spark, d, "text"), "provision_id", "text")
    return w.groupBy("provision_id").agg(F.count("*").alias("n_terms"), F.round(F.max("norm"), 6).alias("norm"), F.round(F.max("weight"), 6).alias("top_weight"))


@query(f"WITH {S.PASSAGES}, s AS (SELECT doc_id, coalesce(domain, '-') dom, count(*) n FROM p GROUP BY 1, 2), b AS (SELECT doc_id, arg_max(dom, (n, dom)) AS main_domain, count(*) AS n_domains FROM s GROUP BY 1) SELECT main_domain, count(*) AS n_docs, count_if(n_domains > 1)::BIGINT AS n_mixed FROM b GROUP BY 1")
def dominant_domain(spark: SparkSession, d: str) -> DataFrame:
    s = O.passages(spark, d, "doc_id", "domain").groupBy("doc_id", F.coalesce("domain", F.lit("-")).alias("dom")).agg(F.count("*").alias("n"))
    b = s.groupBy("doc_id").agg(F.max_by("dom", F.struct("n", "dom")).alias("main_domain"), F.count("*").alias("n_domains"))
    return b.groupBy("main_domain").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_domains") > 1).alias("n_mixed"))


@query(f"WITH {S.PASSAGES}, c AS (SELECT doc_id, silver, count(*) n FROM p WHERE silver IS NOT NULL GROUP BY 1, 2), t AS (SELECT silver, count(DISTINCT doc_id) m, sum(n) n FROM c GROUP BY 1) SELECT round(max(n) * 1.0 / sum(n), 8) AS majority, round(2 * (max(n) * 1.0 / sum(n)) / (1 + max(n) * 1.0 / sum(n)) / count(*), 8) AS degenerate_f1, round(avg(m), 8) AS mean_docs, min(m) AS min_docs FROM t")
def chance_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Majority share, the macro-F1 of always answering it, and documents per label value."""
    t = O.passages(spark, d, "doc_id", "silver").where("silver is not null").groupBy("silver").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("m"))
    share = F.max("n") / F.sum("n")
    return t.agg(F.round(share, 8).alias("majority"), F.round(2 * share / (1 + share) / F.count("*"), 8).alias("degenerate_f1"), F.round(F.avg("m"), 8).alias("mean_docs"), F.min("m").alias("min_docs"))




def _paired_sql(pred: str, tag: str) -> str:
    """The bootstrap's tables for one prediction; both predictions share rows, clusters and draws."""
    return f"""c{tag} AS (SELECT grp, gold t, {pred} p, count(*) n FROM r GROUP BY 1, 2, 3), w{tag} AS (SELECT rep, t, p, sum(n * m) n FROM m JOIN k USING (j) JOIN c{tag} USING (grp) GROUP BY 1, 2, 3),
e{tag} AS (SELECT rep, v, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT rep, t v, CASE WHEN t = p THEN n ELSE 0 END tp, 0 fp, CASE WHEN t <> p THEN n ELSE 0 END fn FROM w{tag} UNION ALL SELECT rep, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM w{tag}) GROUP BY 1, 2),
f{tag} AS (SELECT rep, avg(2.0 * tp / (2 * tp + fp + fn)) f FROM e{tag} GROUP BY 1)"""


@query(f"""WITH {S.PASSAGES}, r AS (SELECT grp, gold, rule_label, nli_label FROM p WHERE gold IS NOT NULL AND rule_label IS NOT NULL AND nli_label IS NOT NULL), k AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', 'b2', grp)), grp) - 1 j FROM (SELECT DISTINCT grp FROM r)), z AS (SELECT count(*) z FROM k),
dr AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'b2', rep, k.j)), 1, 12))::BIGINT % z j FROM (SELECT unnest(range(2000)) rep), k, z), m AS (SELECT rep, j, count(*) m FROM dr GROUP BY 1, 2), {_paired_sql('rule_label', 'a')}, {_paired_sql('nli_label', 'b')}
SELECT round(quantile_cont(fa.f / fb.f, 0.025), 6) AS low, round(quantile_cont(fa.f / fb.f, 0.5), 6) AS mid, round(quantile_cont(fa.f / fb.f, 0.975), 6) AS high, round(avg((fa.f > fb.f)::INT), 6) AS share_better FROM fa JOIN fb USING (rep)""")  # fmt: skip
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of the rules' macro-F1 to the model's under the same cluster draws."""
    b = R.paired_bootstrap(O.passages(spark, d, "gold", "rule_label", "nli_label"), "grp", "gold", "rule_label", "nli_label", 2000, "b2")
    b = b.withColumn("ratio", F.col("f1_one") / F.col("f1_two"))
    q = R.interval(b, "ratio").select(*[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])
    return q.crossJoin(F.broadcast(b.agg(F.round(F.avg((F.col("f1_one") > F.col("f1_two")).cast("int")), 6).alias("share_better"))))  # one row each


def _f1_sql(pred: str, tag: str) -> str:
    """(grp, f): macro-F1 of a prediction by group."""
    return f"""e{tag} AS (SELECT grp, v, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT grp, gold v, (gold = {pred})::INT tp, 0 fp, (gold <> {pred})::INT fn FROM r UNION ALL SELECT grp, {pred}, 0, (gold <> {pred})::INT, 0 FROM r) GROUP BY 1, 2),
f{tag} AS (SELECT grp, avg(2.0 * tp / (2 * tp + fp + fn)) f FROM e{tag} GROUP BY 1)"""


_THREE = "r AS (SELECT grp, gold, rule_label, nli_label FROM p WHERE gold IS NOT NULL AND rule_label IS NOT NULL AND nli_label IS NOT NULL)"
_GAPS = f"{S.PASSAGES}, {_THREE}, {_f1_sql('rule_label', 'a')}, {_f1_sql('nli_label', 'b')}, g AS (SELECT grp, fa.f - fb.f AS d FROM fa JOIN fb USING (grp))"


@query(f"""WITH {_GAPS}, c AS (SELECT count(*) n_blocks, count_if(d > 1e-12)::BIGINT better, count_if(d < -1e-12)::BIGINT worse, avg(d) mean FROM g),
x AS (SELECT *, unnest(range(0, least(better, worse) + 1)) i FROM c) SELECT n_blocks, better, worse, round(mean, 8) AS mean, round(least(1.0, 2 * sum(exp(lgamma(better+worse+1) - lgamma(i+1) - lgamma(better+worse-i+1) - (better+worse) * ln(2.0)))), 6) AS p, round(3 / (2.0 ** n_blocks + 1), 10) AS floor FROM x GROUP BY ALL""")  # fmt: skip
def block_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Rules against the model by group: macro-F1, sign test and its floor."""
    c = R.block_contrast(O.passages(spark, d, "gold", "rule_label", "nli_label"), "grp", "gold", "rule_label", "nli_label")
    return c.select("n_blocks", "better", "worse", F.round("mean", 8).alias("mean"), F.round("p", 6).alias("p"), F.round("floor", 10).alias("floor"))


@query(f"""WITH {S.PASSAGES}, {_THREE}, k AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', 'b3', grp)), grp) - 1 j FROM (SELECT DISTINCT grp FROM r)), z AS (SELECT count(*) z FROM k),
dr AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'b3', rep, k.j)), 1, 12))::BIGINT % z j FROM (SELECT unnest(range(2000)) rep), k, z), m AS (SELECT rep, j, count(*) m FROM dr GROUP BY 1, 2), {_paired_sql('rule_label', 'a')}, {_paired_sql('nli_label', 'b')}
SELECT {', '.join(f"round(quantile_cont({e}, {x}), 6) AS {c}_{n}" for c, e in (('f1_one', 'fa.f'), ('f1_two', 'fb.f'), ('ratio', 'CASE WHEN fb.f <> 0 THEN fa.f / fb.f END')) for n, x in (('low', 0.025), ('high', 0.975)))},
  round(least(1.0, (1 + count_if(fa.f <= fb.f)) * 2.0 / (count(*) + 1)), 6) AS gap_p FROM fa JOIN fb USING (rep)""")  # fmt: skip
def paired_interval(spark: SparkSession, d: str) -> DataFrame:
    """Rules and model on the same resampled groups: intervals of both and of their ratio, and p of the gap."""
    b = R.paired_bootstrap(O.passages(spark, d, "gold", "rule_label", "nli_label"), "grp", "gold", "rule_label", "nli_label", 2000, "b3")
    got = R.paired_interval(b)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query(f"""WITH {S.PASSAGES}, c AS (SELECT gold t, nli_label p, count(*) n FROM p WHERE gold IS NOT NULL AND nli_label IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, sum(n) OVER (ORDER BY t, p) AS hi, sum(n) OVER (ORDER BY t, p) - n AS lo FROM c), z AS (SELECT sum(n)::BIGINT z FROM c),
dr AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'b4', rep, s)), 1, 12))::BIGINT % z AS j FROM (SELECT unnest(range(200)) rep), (SELECT unnest(range(z)) s, z FROM z)), w AS (SELECT rep, t, p, count(*) n FROM dr JOIN o ON j >= lo AND j < hi GROUP BY 1, 2, 3),
e AS (SELECT rep, v, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT rep, t v, CASE WHEN t = p THEN n ELSE 0 END tp, 0 fp, CASE WHEN t <> p THEN n ELSE 0 END fn FROM w UNION ALL SELECT rep, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM w) GROUP BY 1, 2)
SELECT rep, round(avg(2.0 * tp / (2 * tp + fp + fn)), 8) AS macro_f1 FROM e GROUP BY 1""")  # fmt: skip
def row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 of the model labels under 200 resamples of the rows."""
    return R.row_bootstrap(O.passages(spark, d, "gold", "nli_label"), "gold", "nli_label", 200, "b4").select("rep", F.round("macro_f1", 8).alias("macro_f1"))


_DRAWS = """k AS (SELECT e, row_number() OVER (ORDER BY md5(concat_ws('|', '{0}', e)), e) - 1 j FROM (SELECT DISTINCT e FROM {1})), z AS (SELECT count(*) z FROM k),
dr AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', '{0}', rep, k.j)), 1, 12))::BIGINT % z j FROM (SELECT unnest(range({2})) rep), k, z), dw AS (SELECT rep, e, count(*) m FROM dr JOIN k USING (j) GROUP BY 1, 2)"""
_CI = "round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.5), 8) AS mid, round(quantile_cont(mean, 0.975), 8) AS high"


@query(f"WITH {_CELLS}, v AS (SELECT grp AS e, diff FROM c WHERE diff IS NOT NULL), {_DRAWS.format('b5', 'v', 5000)}, b AS (SELECT rep, sum(diff * m) / sum(m) AS mean FROM dw JOIN v USING (e) GROUP BY 1) SELECT {_CI} FROM b")
def mean_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean difference of the cell rates under resampled groups."""
    b = R.mean_bootstrap(_cells(spark, d), "grp", "diff", 5000, "b5")
    return R.interval(b, "mean").select(*[F.round(c, 8).alias(c) for c in ("low", "mid", "high")])


_PAIR_JSD = "SELECT x.domain, x.grp AS a, y.grp AS b, sum(0.5 * x.q * log2(x.q / ((x.q + y.q) / 2)) + 0.5 * y.q * log2(y.q / ((x.q + y.q) / 2))) AS jsd FROM q x JOIN q y ON x.domain = y.domain AND x.label = y.label AND x.grp < y.grp GROUP BY 1, 2, 3"


@query(f"""WITH {_DIST}, j AS ({_PAIR_JSD}), t AS (SELECT a, b, x.jsd - y.jsd AS d FROM j x JOIN j y USING (a, b) WHERE x.domain = 'civil' AND y.domain = 'criminal'), u AS (SELECT a AS e FROM t UNION SELECT b FROM t), {_DRAWS.format('b6', 'u', 2000)},
b AS (SELECT x.rep, avg(d) AS mean FROM t JOIN dw x ON x.e = t.a JOIN dw y ON y.e = t.b AND y.rep = x.rep GROUP BY 1 HAVING count(*) >= 3) SELECT {_CI}, count(*) AS n_reps FROM b""")  # fmt: skip
def pair_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of civil less criminal divergence between groups, groups resampled rather than pairs."""
    j = M.jsd(_dist(spark, d), "grp", "domain")
    side = lambda x: j.where(F.col("domain") == x).select("a", "b", F.col("jsd").alias(x))
    t = side("civil").join(side("criminal"), ["a", "b"]).select("a", "b", (F.col("civil") - F.col("criminal")).alias("d"))
    b = R.pair_bootstrap(t, "a", "b", "d", 2000, "b6")
    return R.interval(b, "mean").select(*[F.round(c, 8).alias(c) for c in ("low", "mid", "high")]).crossJoin(F.broadcast(b.agg(F.count("*").alias("n_reps"))))  # one row each


@query(f"""WITH {_CELLS}, k AS (SELECT grp, diff FROM c WHERE diff IS NOT NULL), f AS (SELECT rep, avg((diff + 0.1) * sg) lo, avg((diff - 0.1) * sg) hi FROM (SELECT rep, diff, CASE WHEN substr(md5(concat_ws('|', 'f2', rep, grp)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END sg FROM k, (SELECT unnest(range(20000)) rep)) GROUP BY 1), o AS (SELECT avg(diff) m, count(*) n FROM k)
SELECT n, round(m, 8) AS mean, round((1 + count_if(lo <= -abs(m + 0.1) + 1e-12)) / 20001.0, 8) AS p_lower, round((1 + count_if(hi >= abs(m - 0.1) - 1e-12)) / 20001.0, 8) AS p_upper, greatest((1 + count_if(lo <= -abs(m + 0.1) + 1e-12)) / 20001.0, (1 + count_if(hi >= abs(m - 0.1) - 1e-12)) / 20001.0) < 0.05 AS equivalent FROM f, o GROUP BY n, m""")  # fmt: skip
def equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mean difference of the cell rates lies within a tenth of nothing."""
    got = R.equivalence(_cells(spark, d), "grp", "diff", 0.1, 20000, "f2")
    return got.select("n", *[F.round(c, 8).alias(c) for c in ("mean", "p_lower", "p_upper")], "equivalent")


def _floor_sql(dom: str) -> str:
    cuts = f"(SELECT list(label ORDER BY label) ls, list(e ORDER BY label) es FROM (SELECT label, sum(n) OVER (ORDER BY label) / sum(n) OVER () AS e FROM k WHERE domain = '{dom}'))"
    return f"""u{dom} AS (SELECT rep, arm, ls[least(len(list_filter(es, lambda e: e <= ('0x' || substr(md5(concat_ws('|', 'n-{dom}', rep, arm, s)), 1, 12))::BIGINT / 281474976710656.0)) + 1, len(ls))] AS label FROM (SELECT unnest(range(5000)) rep), (SELECT unnest(range(2)) arm), (SELECT unnest(range(27)) s), {cuts}),
w{dom} AS (SELECT rep, l.label, count_if(arm = 0 AND u.label = l.label) c0, count_if(arm = 1 AND u.label = l.label) c1 FROM u{dom} u, (SELECT label FROM k WHERE domain = '{dom}') l GROUP BY 1, 2),
p{dom} AS (SELECT rep, (c0 + 1e-12) / (27 + 1e-12 * count(*) OVER (PARTITION BY rep)) a, (c1 + 1e-12) / (27 + 1e-12 * count(*) OVER (PARTITION BY rep)) b FROM w{dom}),
j{dom} AS (SELECT rep, sum(0.5 * a * log2(a / ((a + b) / 2)) + 0.5 * b * log2(b / ((a + b) / 2))) jsd FROM p{dom} GROUP BY 1)"""


@query(f"WITH {S.PASSAGES}, k AS (SELECT domain, silver AS label, count(*) n FROM p WHERE domain IN ('civil', 'criminal') AND silver IS NOT NULL GROUP BY 1, 2), {_floor_sql('civil')}, {_floor_sql('criminal')} "
       + " UNION ALL ".join(f"SELECT '{x}' AS domain, round(avg(jsd), 6) AS floor_mean, round(quantile_cont(jsd, 0.95), 6) AS floor_p95 FROM j{x}" for x in ("civil", "criminal")))
def divergence_floor(spark: SparkSession, d: str) -> DataFrame:
    """Divergence that two samples of 27 of one distribution have by chance, from 5000 draws, by domain."""
    counts: dict[str, dict[str, int]] = {"civil": {}, "criminal": {}}
    for r in O.passages(spark, d, "domain", "silver").where("domain in ('civil', 'criminal') and silver is not null").groupBy("domain", "silver").count().collect():  # labels of two domains
        counts[r.domain][r.silver] = r["count"]
    parts = []
    for dom, c in counts.items():
        if c:
            f = R.divergence_floor(c, 27, 5000, f"n-{dom}", spark)
            parts.append(f.agg(F.round(F.avg("jsd"), 6).alias("floor_mean"), F.round(F.percentile("jsd", F.lit(0.95)), 6).alias("floor_p95")).select(F.lit(dom).alias("domain"), "floor_mean", "floor_p95"))
    if not parts:
        return spark.createDataFrame([], "domain string, floor_mean double, floor_p95 double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@query(f"""WITH {S.PASSAGES}, r AS (SELECT provision_id, grp g, silver l FROM p WHERE silver IS NOT NULL), q AS (SELECT rep, g, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', 't1', rep, provision_id)), provision_id) k FROM r, (SELECT unnest(range(20)) rep)),
b AS (SELECT l, row_number() OVER (ORDER BY {S.order('t1', 'provision_id')}, provision_id) k FROM r), c AS (SELECT rep, g, l, count(*) n FROM q JOIN b USING (k) GROUP BY 1, 2, 3 UNION ALL SELECT -1, g, l, count(*) FROM r GROUP BY 2, 3), t AS (SELECT rep, sum(n) t FROM c GROUP BY 1),
hl AS (SELECT rep, ln(sum(n)) - sum(n * ln(n)) / sum(n) h FROM (SELECT rep, l, sum(n) n FROM c GROUP BY 1, 2) GROUP BY 1), hg AS (SELECT rep, sum(h * m) / sum(m) h FROM (SELECT rep, g, ln(sum(n)) - sum(n * ln(n)) / sum(n) h, sum(n) m FROM c GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT rep, (hl.h - hg.h) / hl.h AS u FROM hl JOIN hg USING (rep)), o AS (SELECT u FROM u WHERE rep = -1)
SELECT round(o.u, 8) AS u, round(avg(u.u), 8) AS "null", round((o.u - avg(u.u)) / (1 - avg(u.u)), 8) AS adjusted, round((1 + count_if(u.u >= o.u - 1e-12)) / (1.0 + count(*)), 8) AS p FROM u, o WHERE rep >= 0 GROUP BY o.u""")  # fmt: skip
def theil_u_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Share of the label's entropy that the group fixes, beyond what labels dealt anew leave (20 permutations)."""
    got = M.theil_u_adjusted(O.passages(spark, d, "silver"), "grp", "silver", "provision_id", 20, "t1")
    return got.select(*[F.round(c, 8).alias(c) for c in got.columns])


@query()
def block_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope of rule support on the length of a passage over four levels of length, levels permuted as blocks of one draw a group."""
    words = F.least(F.lit(4), F.ceil(F.coalesce("n_words", F.lit(0)) / 40)).cast("int")
    rows = O.passages(spark, d, "n_words", "rule_support").groupBy("grp", words.alias("level")).agg((F.avg("rule_support") + 1).alias("v"))
    got = R.block_slope(rows, "level", "v", 2000)
    return got.select("n_levels", *[F.round(c, 8).alias(c) for c in got.columns[1:]])


def _nest_sql(label: str) -> str:
    return f"""(SELECT '{label}' AS label, round((hl.h - hg.h) / nullif(hl.h, 0), 8) AS u, hl.n AS n_rows FROM (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) h, sum(n)::BIGINT n FROM (SELECT count(*) n FROM p WHERE {label} IS NOT NULL GROUP BY {label})) hl,
(SELECT sum(h * m) / sum(m) h FROM (SELECT doc_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) h, sum(n) m FROM (SELECT doc_id, {label}, count(*) n FROM p WHERE {label} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)) hg)"""


@query(f"WITH p AS (SELECT doc_id, grp, silver, domain, coalesce(modality[1], 'NONE') AS first_modality FROM (WITH {S.PASSAGES} SELECT * FROM p)) " + " UNION ALL ".join(f"SELECT * FROM {_nest_sql(x)}" for x in ("grp", "silver", "first_modality", "domain")))
def label_nesting(spark: SparkSession, d: str) -> DataFrame:
    """How far documents fix each of four labels: Theil's U by document."""
    p = O.passages(spark, d, "doc_id", "silver", "domain", "modality").withColumn("first_modality", F.coalesce(F.get("modality", F.lit(0)), F.lit("NONE")))
    parts = [M.theil_u(p, "doc_id", x).crossJoin(F.broadcast(p.agg(F.count(x).alias("n_rows")))).select(F.lit(x).alias("label"), F.round("u", 8).alias("u"), "n_rows") for x in ("grp", "silver", "first_modality", "domain")]  # one row each
    return functools.reduce(DataFrame.unionByName, parts)


_BORROWED = f"({S.rx('coalesce(text, ' + chr(39) * 2 + ')', P.EXTERNAL)} OR {S.rx('coalesce(text, ' + chr(39) * 2 + ')', P.BLANKS)})"


@query(f"""WITH {S.PASSAGES}, c AS (SELECT condition, grp, avg({_BORROWED}::INT) FILTER (WHERE domain = 'civil') - avg({_BORROWED}::INT) FILTER (WHERE domain = 'criminal') AS diff FROM (SELECT 'all' AS condition, * FROM p UNION ALL SELECT 'no_copies', * FROM p WHERE NOT coalesce(xnation_dup, false) UNION ALL SELECT 'no_scans', * FROM p WHERE NOT coalesce(ocr, false)) GROUP BY 1, 2),
k AS (SELECT condition, grp, diff FROM c WHERE diff IS NOT NULL), s AS (SELECT condition, rep, sum(CASE WHEN substr(md5(concat_ws('|', 'a1', rep, grp)), 1, 1) < '8' THEN diff ELSE -diff END) t FROM k, (SELECT unnest(range(5000)) rep) GROUP BY 1, 2), o AS (SELECT condition, sum(diff) s, count(*) n FROM k GROUP BY 1)
SELECT condition, n, round(o.s / n, 8) AS mean, round((1 + count_if(abs(t) >= abs(o.s) - 1e-12)) / 5001.0, 8) AS p FROM s JOIN o USING (condition) GROUP BY condition, n, o.s""")  # fmt: skip
def adoption_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Borrowed drafting, civil less criminal by group, under three conditions of one scan, with a sign-flip test."""
    p = O.passages(spark, d, "text", "domain", "xnation_dup", "ocr").select("grp", "domain", T.borrowed(F.col("text")).cast("int").alias("b"), F.coalesce("xnation_dup", F.lit(False)).alias("dup"), F.coalesce("ocr", F.lit(False)).alias("scan"))
    rows = L.conditions(p, {"all": F.lit(True), "no_copies": ~F.col("dup"), "no_scans": ~F.col("scan")})
    rate = lambda x: F.avg(F.when(F.col("domain") == x, F.col("b")))
    cells = rows.groupBy("condition", "grp").agg((rate("civil") - rate("criminal")).alias("diff"))
    parts = [R.sign_flip(cells.where(F.col("condition") == c), "grp", "diff", 5000, "a1").select(F.lit(c).alias("condition"), "n", F.round("mean", 8).alias("mean"), F.round("p", 8).alias("p")) for c in ("all", "no_copies", "no_scans")]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"WITH {S.PASSAGES}, k AS (SELECT grp, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', 'h1', grp, doc_id)), doc_id) r FROM (SELECT DISTINCT grp, doc_id FROM p WHERE text IS NOT NULL AND trim(text) <> '')) WHERE r <= 3) SELECT p.grp AS label, count(*) AS n, count(DISTINCT p.doc_id) AS n_docs FROM p JOIN k ON k.grp = p.grp AND k.doc_id = p.doc_id WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1")
def pool_quota(spark: SparkSession, d: str) -> DataFrame:
    """A pool with three documents of each group."""
    pool = L.adapted(O.passages(spark, d, "doc_id", "text"), F.col("grp"), F.col("doc_id"), F.col("text"))
    return L.quota(pool, 3, "h1").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
