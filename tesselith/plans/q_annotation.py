"""Queries: gold labels from a coded queue, replies of a language model, training-free references.

The coder is the gold column, which answers late for a few items as a hash tells; so the same sheet can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.operators import annotation as A
from tesselith.operators import measures as M
from tesselith.operators import passages as O
from tesselith.operators import resample as R
from tesselith.operators import splits as X
from tesselith.plans import sqltext as S

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HEX = "('0x' || substr({0}, 1, 8))::BIGINT / 4294967296.0"
_SHEET = f"""{S.PASSAGES}, g AS (SELECT provision_id, grp, coalesce(gold, silver) AS truth, silver, rule_label, nli_label FROM p WHERE gold IS NOT NULL), i0 AS (SELECT *, row_number() OVER (ORDER BY {S.order('q1', 'provision_id')}, provision_id) k, {S.order('q1', 'provision_id')} h FROM g),
i1 AS (SELECT provision_id, truth, rule_label, nli_label, CASE WHEN {_HEX.format(S.order('q1-shown', 'provision_id'))} < 0.67 THEN silver END AS suggested, k::DOUBLE AS place, h FROM i0 UNION ALL SELECT provision_id, truth, rule_label, nli_label, NULL, k + 20.5, h FROM i0 WHERE k <= 30),
i2 AS (SELECT *, row_number() OVER (ORDER BY place, h, provision_id) - 1 AS i FROM i1),
s AS (SELECT *, CASE WHEN substr(md5(concat_ws('|', 'late', i)), 1, 1) < '2' THEN '{A.UNJUDGED}' WHEN substr(md5(concat_ws('|', 'slip', i)), 1, 1) < '2' THEN coalesce(nli_label, truth) ELSE truth END AS label FROM i2)"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """i, provision_id, suggested, rule_label, nli_label, label: the queue joined with what was coded."""
    g = O.passages(spark, d, "gold", "silver", "rule_label", "nli_label").where("gold is not null")
    q = X.review_queue(g, "provision_id", F.col("silver"), 0.67, 30, 20, "q1").select(F.col("i").cast("bigint").alias("i"), F.col("key").alias("provision_id"), "suggested")
    items = q.join(g.select("provision_id", F.col("gold").alias("truth"), "rule_label", "nli_label"), "provision_id")
    first = lambda seed: F.substring(O.by_hash(seed, F.col("i").cast("string")), 1, 1) < "2"
    label = F.when(first("late"), A.UNJUDGED).when(first("slip"), F.coalesce("nli_label", "truth")).otherwise(F.col("truth"))
    return A.coded(items, items.select("i", label.alias("label")))


@query(f"WITH {_SHEET}, f AS (SELECT provision_id, label AS gold FROM s WHERE label <> '{A.UNJUDGED}' QUALIFY row_number() OVER (PARTITION BY provision_id ORDER BY i) = 1) SELECT provision_id, gold FROM f")
def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first judgement of every provision that was coded."""
    return A.gold(_sheet(spark, d), "provision_id")


@query(f"""WITH {_SHEET}, f AS (SELECT provision_id, label AS new FROM s WHERE label <> '{A.UNJUDGED}' QUALIFY row_number() OVER (PARTITION BY provision_id ORDER BY i) = 1)
SELECT coalesce(new, gold) AS gold, count(*) AS n, count_if(new IS DISTINCT FROM gold AND new IS NOT NULL)::BIGINT AS n_changed FROM p LEFT JOIN f USING (provision_id) GROUP BY 1""")  # fmt: skip
def gold_update(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the coded labels: rows of each label, and those that the coding changed."""
    old = O.passages(spark, d, "gold")
    new = A.with_gold(old.withColumn("before", F.col("gold")), A.gold(_sheet(spark, d), "provision_id"), "provision_id")
    return new.groupBy("gold").agg(F.count("*").alias("n"), F.count_if(~F.col("gold").eqNullSafe(F.col("before"))).alias("n_changed"))


@query(f"""WITH {_SHEET}, t AS (SELECT provision_id, min_by(label, i) a, max_by(label, i) b, count(suggested) = 0 AS blind FROM s GROUP BY 1 HAVING count(*) = 2), w AS (SELECT 'all' AS which, a, b FROM t UNION ALL SELECT 'blind_only', a, b FROM t WHERE blind),
n AS (SELECT which, count(*) n, avg((a = b)::INT) o FROM w GROUP BY 1), e AS (SELECT x.which, sum(x.n * 1.0 * y.n) s FROM (SELECT which, a, count(*) n FROM w GROUP BY 1, 2) x JOIN (SELECT which, b, count(*) n FROM w GROUP BY 1, 2) y ON x.which = y.which AND x.a = y.b GROUP BY 1)
SELECT which, n, round(o, 8) AS raw, round((o - s / n / n) / (1 - s / n / n), 8) AS kappa FROM n JOIN e USING (which)""")  # fmt: skip
def coder_reliability(spark: SparkSession, d: str) -> DataFrame:
    """How the coder agrees with themselves on provisions shown twice."""
    r = A.reliability(A.repeats(_sheet(spark, d), "provision_id"))
    return r.select("which", "n", F.round("raw", 8).alias("raw"), F.round("kappa", 8).alias("kappa"))


@query(f"""WITH {_SHEET} SELECT CASE WHEN suggested IS NULL THEN 'blind' ELSE 'suggested' END AS shown, count(*) AS n, count(rule_label) AS rule_n, round(avg((rule_label = label)::INT), 8) AS rule_rate, round(avg(coalesce((nli_label = label)::INT, 0)), 8) AS model_rate, round(avg((suggested = label)::INT), 8) AS accepted FROM s WHERE label <> '{A.UNJUDGED}' GROUP BY 1""")
def coder_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Rules and model against the coder, blind and with a suggestion shown."""
    a = A.agreement(_sheet(spark, d), "rule_label", "nli_label")
    return a.select("shown", "n", "rule_n", *[F.round(c, 8).alias(c) for c in ("rule_rate", "model_rate", "accepted")])


# A package: provisions in blocks of five groups' worth of items; regime one answers the model label, regime two the rule's, with noise lines.
_PACK = f"""{S.PASSAGES}, b0 AS (SELECT provision_id, grp, gold, nli_label, rule_label, ('0x' || substr(md5(concat_ws('|', 'blk', provision_id)), 1, 4))::BIGINT % 4 AS block FROM p WHERE gold IS NOT NULL), b1 AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY provision_id) AS n FROM b0),
i AS (SELECT regime || '-' || block AS tag, n, provision_id, grp, gold, block, regime, CASE WHEN regime = 'random' THEN nli_label ELSE rule_label END AS reply FROM b1, (VALUES ('random'), ('heldout')) r(regime)), a AS (SELECT *, CASE WHEN n % 17 = 0 THEN 'DEFINITION' ELSE reply END AS pred FROM i)"""


def _package(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(index: tag, n, provision_id, grp, gold, block, regime; texts: tag, text)."""
    g = O.passages(spark, d, "gold", "nli_label", "rule_label").where("gold is not null")
    block = F.conv(F.substring(O.by_hash("blk", "provision_id"), 1, 4), 16, 10).cast("bigint") % 4
    ranked = X.hash_rank(g.withColumn("block", block), ["block"], F.col("provision_id"), "provision_id", "n")
    both = ranked.withColumn("regime", F.explode(F.array(F.lit("random"), F.lit("heldout"))))
    both = both.withColumn("tag", F.concat_ws("-", "regime", "block")).withColumn("reply", F.when(F.col("regime") == "random", F.col("nli_label")).otherwise(F.col("rule_label")))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("reply", F.lit("no idea")))
    said = F.when(F.col("n") % 17 == 0, F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] DEFINITION\n"), line)).otherwise(line)  # an answer given twice: the first counts
    texts = both.groupBy("tag").agg(F.concat(F.lit("Here are the labels:\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("l")))), lambda x: x["l"]), "\n")).alias("text"))
    return both.select("tag", "n", "provision_id", "grp", "gold", "block", "regime"), texts


@query(f"WITH {_PACK} SELECT tag, count(pred) AS n_answers, (1 + count_if(pred IS NULL) + count_if(n % 17 = 0))::BIGINT AS n_bad FROM a GROUP BY 1")
def reply_counts(spark: SparkSession, d: str) -> DataFrame:
    """Answers and lines that are none in every reply of a package."""
    return A.replies(_package(spark, d)[1], "tag", "text", list(P.LABELS))[1]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    index, texts = _package(spark, d)
    return A.answered(index, A.replies(texts, "tag", "text", list(P.LABELS))[0])


@query(f"""WITH {_PACK}, m AS (SELECT regime, gold t, pred p FROM a WHERE pred IS NOT NULL), l AS (SELECT regime, t v FROM m UNION SELECT regime, p FROM m),
f AS (SELECT regime, v, (SELECT count(*) FROM m WHERE m.regime = l.regime AND t = v AND p = v) tp, (SELECT count(*) FROM m WHERE m.regime = l.regime AND t <> v AND p = v) fp, (SELECT count(*) FROM m WHERE m.regime = l.regime AND t = v AND p <> v) fn FROM l)
SELECT regime, round(avg(2.0 * tp / (2 * tp + fp + fn)), 8) AS macro_f1, (SELECT count(*) FROM m WHERE m.regime = f.regime) AS n FROM f GROUP BY 1""")  # fmt: skip
def reply_scores(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 of the answers by regime."""
    return M.macro_f1(M.confusion(_answers(spark, d), "gold", "pred", "regime"), "regime").select("regime", F.round("macro_f1", 8).alias("macro_f1"), "n")


@query(f"""WITH {_PACK}, w AS (SELECT provision_id, max(CASE WHEN regime = 'random' THEN (pred = gold)::INT END) a, max(CASE WHEN regime = 'heldout' THEN (pred = gold)::INT END) b FROM a WHERE pred IS NOT NULL GROUP BY 1), c AS (SELECT count_if(a = 1 AND b = 0)::BIGINT x, count_if(b = 1 AND a = 0)::BIGINT y FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT *, unnest(range(0, least(x, y) + 1)) i FROM c) SELECT x AS only_one, y AS only_two, round(least(1.0, 2 * sum(exp(lgamma(x+y+1) - lgamma(i+1) - lgamma(x+y-i+1) - (x+y) * ln(2.0)))), 6) AS p FROM t GROUP BY x, y""")  # fmt: skip
def reply_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Items on which only one of the two regimes is right."""
    a = _answers(spark, d).where("pred is not null")
    side = lambda x: a.where(F.col("regime") == x).select("provision_id", "gold", F.col("pred").alias(x))
    return R.mcnemar(side("random").join(side("heldout").drop("gold"), "provision_id"), "gold", "random", "heldout").withColumn("p", F.round("p", 6))


@query(f"""WITH {S.PASSAGES}, r AS (SELECT gold t, coalesce(rule_label, 'PROCEDURE') a, coalesce(nli_label, 'PROCEDURE') b FROM p WHERE gold IS NOT NULL), w AS (SELECT 'rule' AS which, t, a AS p FROM r UNION ALL SELECT 'model', t, b FROM r), l AS (SELECT which, t v FROM w UNION SELECT which, p FROM w),
f AS (SELECT which, v, (SELECT count(*) FROM w WHERE w.which = l.which AND t = v AND p = v) tp, (SELECT count(*) FROM w WHERE w.which = l.which AND t <> v AND p = v) fp, (SELECT count(*) FROM w WHERE w.which = l.which AND t = v AND p <> v) fn FROM l)
SELECT which, round(avg(2.0 * tp / (2 * tp + fp + fn)), 8) AS macro_f1 FROM f GROUP BY 1""")  # fmt: skip
def training_free_references(spark: SparkSession, d: str) -> DataFrame:
    """Rules and model labels against gold, with the default where they are silent."""
    r = A.references(O.passages(spark, d, "gold", "rule_label", "nli_label").where("gold is not null"))
    both = r.select("gold", F.explode(F.create_map(F.lit("rule"), "pred_rule", F.lit("model"), "pred_model")).alias("which", "p"))
    return M.macro_f1(M.confusion(both, "gold", "p", "which"), "which").select("which", F.round("macro_f1", 8).alias("macro_f1"))


@query()
def zero_shot_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the stand-in scorer, counted; any entailment model can take its place."""
    rows = O.passages(spark, d, "text").where("text is not null")
    return A.zero_shot(rows, "provision_id", "text", A.HYPOTHESES).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("probs")[F.col("label")]), 6).alias("mean_prob"))
