"""Queries: scans, filters, keys, labels, agreement of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import measures as M
from tesselith.operators import passages as O
from tesselith.plans import sqltext as S
from tesselith.sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {S.PASSAGES} SELECT grp, count(*) AS n_passages, count(DISTINCT doc_id) AS n_docs, count(text) AS n_texts, sum({S.n_words('text')})::BIGINT AS n_words FROM p GROUP BY 1")
def passage_scan(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "doc_id", "text").groupBy("grp").agg(
        F.count("*").alias("n_passages"), F.count_distinct("doc_id").alias("n_docs"), F.count("text").alias("n_texts"), F.sum(T.n_words(F.col("text"))).alias("n_words"))


@query(f"WITH {S.PASSAGES} SELECT provision_id, ({S.n_words('text')})::BIGINT AS words FROM p WHERE {S.n_words('text')} BETWEEN 15 AND 600")
def word_window_filter(spark: SparkSession, d: str) -> DataFrame:
    words = T.n_words(F.col("text"))
    return O.passages(spark, d, "text").where(words.between(15, 600)).select("provision_id", words.cast("bigint").alias("words"))


_CONTEXT = ("doc_title", "chapter_heading", "heading", "source_url")


@query(f"WITH {S.PASSAGES}, c AS (SELECT provision_id, concat_ws(' ', {', '.join(_CONTEXT)}) t FROM p) SELECT provision_id FROM c WHERE NOT ({S.rx('t', P.OTHER_TOPICS)} AND NOT {S.rx('t', P.CRIMINAL_CUES)} AND NOT {S.rx('t', P.CIVIL_CUES)})")
def topic_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, *_CONTEXT).where(T.on_topic(*map(F.col, _CONTEXT))).select("provision_id")


_HOST = "regexp_replace(lower(regexp_extract(coalesce({0}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"WITH {S.PASSAGES} SELECT {_HOST.format('source_url')} AS host, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "source_url", "doc_id").groupBy(T.host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT DISTINCT doc_id, url, substr(sha1(url), 1, 16) AS url_key FROM harvest_docs WHERE url IS NOT NULL")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "harvest_docs").where("url is not null").select("doc_id", "url", T.url_key(F.col("url")).alias("url_key")).distinct()


@query(f"WITH {S.PASSAGES} SELECT provision_id, coalesce({S.domain('heading_path')}, {S.domain('doc_title')}) AS domain_read, CASE WHEN {S.domain('heading_path')} IS NOT NULL THEN 'heading' WHEN {S.domain('doc_title')} IS NOT NULL THEN 'doc_title' END AS evidence FROM p")
def structural_domain(spark: SparkSession, d: str) -> DataFrame:
    path, title = T.structural_domain(F.col("heading_path")), T.structural_domain(F.col("doc_title"))
    return O.passages(spark, d, "heading_path", "doc_title").select("provision_id", F.coalesce(path, title).alias("domain_read"), F.when(path.isNotNull(), "heading").when(title.isNotNull(), "doc_title").alias("evidence"))


def _cues(p: str) -> str:
    return f"len(regexp_extract_all(concat_ws(' ', chapter_heading, heading), '(?i){p}'))"


@query(f"WITH {S.PASSAGES} SELECT grp, CASE WHEN {_cues(P.CRIMINAL_CUES)} > {_cues(P.CIVIL_CUES)} THEN 'criminal' WHEN {_cues(P.CIVIL_CUES)} > {_cues(P.CRIMINAL_CUES)} THEN 'civil' END AS cue_domain, count(*) AS n FROM p GROUP BY 1, 2")
def cue_count_domain(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "chapter_heading", "heading").groupBy("grp", T.cue_domain(F.col("chapter_heading"), F.col("heading")).alias("cue_domain")).agg(F.count("*").alias("n"))


_W = f"string_split({S.squash(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, ' ')"


@query(f"WITH {S.PASSAGES}, w AS (SELECT provision_id, coalesce(text, '') t, {_W} w FROM p) SELECT provision_id FROM w WHERE len(w) >= 12 AND NOT regexp_matches(t, '{P.DOT_LEADER}') AND len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) * 1.0 / len(w) <= 0.55 AND {S.rx('t', P.VERB_CUE)}")
def substantive_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").where(T.substantive(F.col("text"))).select("provision_id")


@query(f"WITH {S.PASSAGES} SELECT grp, md5(regexp_replace(lower(text), '[^a-z0-9_]+', '', 'g')) AS text_key, min(provision_id) AS provision_id, count(*) AS n_copies FROM p WHERE text IS NOT NULL GROUP BY 1, 2")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = O.passages(spark, d, "text").where("text is not null").select("provision_id", "grp", T.text_key(F.col("text")).alias("text_key"))
    copies = rows.groupBy("grp", "text_key").agg(F.count("*").alias("n_copies"))
    return O.first_wins(rows, ["grp", "text_key"], ["provision_id"]).join(copies, ["grp", "text_key"]).select("grp", "text_key", "provision_id", "n_copies")


@query(f"WITH {S.PASSAGES}, g AS (SELECT grp FROM p GROUP BY 1 HAVING count(*) >= 60) SELECT grp, coalesce(domain, '-') AS dom, count(*) AS n FROM p WHERE grp IN (SELECT grp FROM g) GROUP BY 1, 2")
def group_threshold(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_groups(O.passages(spark, d, "domain"), "grp", 60).groupBy("grp", F.coalesce("domain", F.lit("-")).alias("dom")).agg(F.count("*").alias("n"))


@query(f"WITH {S.PASSAGES} SELECT grp, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_n_groups(spark: SparkSession, d: str) -> DataFrame:
    return O.top(O.passages(spark, d), ["grp"], 12)


@query(f"WITH {S.PASSAGES} SELECT grp, count(*) FILTER (WHERE domain = 'criminal') AS criminal, count(*) FILTER (WHERE domain = 'civil') AS civil, count(*) FILTER (WHERE domain IS NULL) AS unassigned FROM p GROUP BY 1")
def domain_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = O.passages(spark, d, "domain").select("grp", F.coalesce("domain", F.lit("unassigned")).alias("dom"))
    return rows.groupBy("grp").pivot("dom", ["criminal", "civil", "unassigned"]).count().na.fill(0)


@query(f"WITH {S.PASSAGES}, h AS (SELECT provision_id, {S.rule_hits()} l FROM p) SELECT provision_id, l[1] AS label, len(l)::BIGINT AS support FROM h")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    got = O.passages(spark, d, "text", "heading").select("provision_id", T.rule_label(F.col("text"), F.col("heading")).alias("r"))
    return got.select("provision_id", "r.label", F.col("r.support").cast("bigint").alias("support"))


@query(f"WITH {S.PASSAGES} SELECT provision_id, {S.modality()} AS modalities FROM p")
def modality_sets(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").select("provision_id", F.array_join(T.modality(F.col("text")), ",").alias("modalities"))


@query(f"WITH {S.PASSAGES} SELECT provision_id, {S.references()} AS kinds FROM p")
def xref_types(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").select("provision_id", F.array_join(T.references(F.col("text")), ",").alias("kinds"))


_LATEST = "l AS (SELECT provision_id, arg_max(nli_label, (scored_at, nli_label)) AS model_label, max(scored_at) AS at FROM nli_labels GROUP BY 1)"


def latest_labels(spark: SparkSession, d: str) -> DataFrame:
    """The last model label of every provision; of labels at one time the larger."""
    return table(spark, d, "nli_labels").groupBy("provision_id").agg(F.max_by("nli_label", F.struct("scored_at", "nli_label")).alias("model_label"))


@query(f"WITH {S.PASSAGES}, {_LATEST} SELECT provision_id, rule_label AS rule, model_label, coalesce(rule_label, model_label) AS merged, coalesce(rule_label = model_label, false) AS agree FROM p LEFT JOIN l USING (provision_id)")
def silver_merge(spark: SparkSession, d: str) -> DataFrame:
    p = O.passages(spark, d, "rule_label").join(latest_labels(spark, d), "provision_id", "left")
    return p.select("provision_id", F.col("rule_label").alias("rule"), "model_label", F.coalesce("rule_label", "model_label").alias("merged"), F.coalesce(F.col("rule_label") == F.col("model_label"), F.lit(False)).alias("agree"))


@query("SELECT provision_id, key AS label, value AS prob FROM (SELECT provision_id, unnest(map_entries(nli_probs), recursive := true) FROM (SELECT DISTINCT provision_id, nli_probs, scored_at FROM nli_labels)) QUALIFY row_number() OVER (PARTITION BY provision_id ORDER BY value DESC, key) = 1")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nli_labels").select("provision_id", F.explode("nli_probs").alias("label", "prob"))
    return rows.groupBy("provision_id").agg(F.min_by(F.struct("label", "prob"), F.struct(-F.col("prob"), "label")).alias("m")).select("provision_id", "m.*")


@query(f"WITH {S.PASSAGES}, {_LATEST}, c AS (SELECT gold t, model_label p FROM p JOIN l USING (provision_id) WHERE gold IS NOT NULL), n AS (SELECT count(*) n, avg((t = p)::INT) o FROM c), e AS (SELECT sum(x.n * 1.0 * y.n) s FROM (SELECT t, count(*) n FROM c GROUP BY 1) x JOIN (SELECT p, count(*) n FROM c GROUP BY 1) y ON x.t = y.p) SELECT n, round(o, 8) AS observed, round(s / n / n, 8) AS expected, round((o - s / n / n) / (1 - s / n / n), 8) AS kappa FROM n, e")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    c = M.confusion(O.passages(spark, d, "gold").join(latest_labels(spark, d), "provision_id"), "gold", "model_label")
    return M.kappa(c).select("n", *[F.round(x, 8).alias(x) for x in ("observed", "expected", "kappa")])


@query(f"WITH {S.PASSAGES}, c AS (SELECT rule_label t, silver p FROM p WHERE rule_label IS NOT NULL AND silver IS NOT NULL), u AS (SELECT t v FROM c UNION ALL SELECT p FROM c), m AS (SELECT v, count(*) m FROM u GROUP BY 1), e AS (SELECT 1 - sum(m * 1.0 * (m - 1)) / (sum(m) * 1.0 * (sum(m) - 1)) d FROM m) SELECT (SELECT count(*) FROM c) AS n, round(1 - (SELECT avg((t <> p)::INT) FROM c) / d, 8) AS alpha FROM e")
def alpha(spark: SparkSession, d: str) -> DataFrame:
    return M.alpha(M.confusion(O.passages(spark, d, "rule_label", "silver"), "rule_label", "silver")).select("n", F.round("alpha", 8).alias("alpha"))


@query(f"WITH {S.PASSAGES} SELECT count(gold) AS n_gold, round(avg((gold = rule_label)::INT), 8) AS rule_rate, round(avg((gold = nli_label)::INT), 8) AS model_rate, count(*) FILTER (WHERE gold IS NOT NULL AND rule_label IS NULL) AS no_rule FROM p")
def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    same = lambda c: F.round(F.avg((F.col("gold") == F.col(c)).cast("int")), 8)
    return O.passages(spark, d, "gold", "rule_label", "nli_label").agg(F.count("gold").alias("n_gold"), same("rule_label").alias("rule_rate"), same("nli_label").alias("model_rate"), F.count_if(F.col("gold").isNotNull() & F.col("rule_label").isNull()).alias("no_rule"))


@query(f"WITH {S.PASSAGES}, c AS (SELECT grp, gold t, coalesce(nli_label, 'PROCEDURE') p FROM p WHERE gold IS NOT NULL) SELECT t, p, count(*) AS n FROM c GROUP BY 1, 2")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(O.passages(spark, d, "gold", "nli_label").withColumn("p", F.coalesce("nli_label", F.lit("PROCEDURE"))), "gold", "p")


_F1 = """c AS (SELECT gold t, coalesce(nli_label, 'PROCEDURE') p FROM p WHERE gold IS NOT NULL), l AS (SELECT t v FROM c UNION SELECT p FROM c),
s AS (SELECT v AS label, (SELECT count(*) FROM c WHERE t = v AND p = v) tp, (SELECT count(*) FROM c WHERE t <> v AND p = v) fp, (SELECT count(*) FROM c WHERE t = v AND p <> v) fn FROM l)"""


@query(f"WITH {S.PASSAGES}, {_F1} SELECT label, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM s")
def per_value_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.per_value_f1(confusion_counts(spark, d)).withColumn("f1", F.round("f1", 8))


@query(f"WITH {S.PASSAGES}, {_F1} SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 8) AS macro_f1, round((SELECT avg((t = p)::INT) FROM c), 8) AS accuracy, (SELECT count(*) FROM c) AS n FROM s")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_f1(confusion_counts(spark, d)).select(F.round("macro_f1", 8).alias("macro_f1"), F.round("accuracy", 8).alias("accuracy"), "n")


@query(f"WITH {S.PASSAGES} SELECT provision_id, CASE WHEN {S.rx(chr(116), P.SUBSTANTIVE_HEAD)} AND {S.rx(chr(116), P.PROCEDURAL_HEAD)} THEN 'both' WHEN {S.rx(chr(116), P.SUBSTANTIVE_HEAD)} THEN 'substantive' WHEN {S.rx(chr(116), P.PROCEDURAL_HEAD)} THEN 'procedural' ELSE 'unmarked' END AS genre, {S.rx('coalesce(text, ' + chr(39) * 2 + ')', P.EXTERNAL)} OR {S.rx('coalesce(text, ' + chr(39) * 2 + ')', P.BLANKS)} AS borrowed FROM (SELECT *, concat_ws(' > ', doc_title, heading_path, chapter_heading) t FROM p)")
def genre_and_borrowing(spark: SparkSession, d: str) -> DataFrame:
    heads = ("doc_title", "heading_path", "chapter_heading")
    return O.passages(spark, d, "text", *heads).select("provision_id", T.genre(*map(F.col, heads)).alias("genre"), T.borrowed(F.col("text")).alias("borrowed"))


@query(f"WITH {S.PASSAGES} SELECT provision_id, {S.mask_numbers('text')} AS masked FROM p WHERE text IS NOT NULL")
def mask_numbers(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").where("text is not null").select("provision_id", T.mask_numbers(F.col("text")).alias("masked"))


_TERMS = ["accused person", "gaming inspector", "boundary dispute", "small claims", "court"]


@query(f"WITH {S.PASSAGES} SELECT provision_id, regexp_replace(text, '(?i)\\b(?:{'|'.join(sorted(_TERMS, key=len, reverse=True))})\\b', '§CUE', 'g') AS masked FROM p WHERE text IS NOT NULL")
def mask_terms(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").where("text is not null").select("provision_id", T.mask_terms(F.col("text"), _TERMS).alias("masked"))


@query()
def mask_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Words and marks that each masking level leaves, by group; every level is made from the one before."""
    p = O.passages(spark, d, "text").where("text is not null").select("grp", F.col("text").alias("m0"))
    for k in range(1, 4):
        p = p.withColumn(f"m{k}", T.mask_step(F.col(f"m{k - 1}"), k, _TERMS))
    p = p.select("grp", *[T.n_words(F.col(f"m{k}")).alias(f"words_m{k}") for k in range(4)], *[F.regexp_count(f"m{k}", F.lit("§[A-Z]+")).alias(f"marks_m{k}") for k in range(4)])
    return p.groupBy("grp").agg(*[F.sum(c).alias(c) for c in p.columns[1:]])


_ENDS = "left(text, 4000) || ' ' || right(text, 2000)"
_YEARS = f"list_max(list_transform(regexp_extract_all({_ENDS}, '{P.YEAR}'), lambda y: y::INT))"


@query(f"WITH {S.PASSAGES} SELECT provision_id, {_YEARS} AS last_year FROM p WHERE regexp_matches({_ENDS}, '{P.YEAR}')")
def publication_year(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").select("provision_id", T.last_year(F.col("text")).alias("last_year")).where("last_year is not null")


@query(f"SELECT doc_id, {_YEARS} AS last_year FROM documents WHERE regexp_matches({_ENDS}, '{P.YEAR}')")
def document_year(spark: SparkSession, d: str) -> DataFrame:
    """The same of the longer texts, of which many are longer than both ends."""
    return table(spark, d, "documents").select("doc_id", T.last_year(F.col("text")).alias("last_year")).where("last_year is not null")


@query(f"WITH {S.PASSAGES} SELECT provision_id, nullif(trim(regexp_extract(coalesce(text, ''), '(?is){P.HISTORY}', 1)), '') AS note, length(trim(regexp_replace(text, '(?is){P.HISTORY}', '', 'g')))::BIGINT AS rest_length FROM p WHERE text IS NOT NULL")
def history_notes(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").where("text is not null").select("provision_id", T.history_note(F.col("text")).alias("note"), F.length(T.without_history(F.col("text"))).cast("bigint").alias("rest_length"))


@query(f"WITH {S.PASSAGES}, l AS (SELECT doc_id, provision_id, coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY char_offset, provision_id), '') before, heading, row_number() OVER (PARTITION BY doc_id ORDER BY char_offset, provision_id) - 1 AS seq, lead(char_offset) OVER (PARTITION BY doc_id ORDER BY char_offset, provision_id) - char_offset AS span FROM p) SELECT doc_id, provision_id, seq::BIGINT AS seq, span::BIGINT AS span, heading IS DISTINCT FROM nullif(before, '') AS new_heading FROM l")
def section_segments(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("char_offset", "provision_id")
    p = O.passages(spark, d, "doc_id", "char_offset", "heading")
    return p.select("doc_id", "provision_id", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), (F.lead("char_offset").over(w) - F.col("char_offset")).cast("bigint").alias("span"),
                    (~F.col("heading").eqNullSafe(F.nullif(F.coalesce(F.lag("heading").over(w), F.lit("")), F.lit("")))).alias("new_heading"))
