"""Queries: samples, folds, regimes, draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.operators import passages as O
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


@query(f"""WITH {S.PASSAGES}, r AS (SELECT provision_id, grp, silver, {S.order('s1', 'provision_id')} h, row_number() OVER (PARTITION BY grp, silver ORDER BY {S.order('s1', 'provision_id')}, provision_id) k FROM p),
n AS (SELECT count(*) k FROM (SELECT DISTINCT grp, silver FROM p)) SELECT provision_id, grp, silver FROM r, n ORDER BY (r.k <= greatest(1, 600 // (3 * n.k))) DESC, h, provision_id LIMIT 600""")  # fmt: skip
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return X.stratified_sample(O.passages(spark, d, "silver"), 600, ["grp", "silver"], "provision_id", "s1").select("provision_id", "grp", "silver")


@query(f"WITH {S.PASSAGES} SELECT provision_id, ((row_number() OVER (PARTITION BY silver ORDER BY {S.order('s2', 'provision_id')}, provision_id) - 1) % 5)::INT AS fold FROM p")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return X.stratified_folds(O.passages(spark, d, "silver"), "silver", "provision_id", 5, "s2").select("provision_id", "fold")


@query(f"WITH {S.PASSAGES}, f AS (SELECT grp, doc_id, ((row_number() OVER (PARTITION BY grp ORDER BY {S.order('s3', 'doc_id')}, doc_id) - 1) % 4)::INT AS fold FROM (SELECT DISTINCT grp, doc_id FROM p)) SELECT fold, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT grp) AS n_groups FROM p JOIN f USING (grp, doc_id) GROUP BY 1")
def doc_folds(spark: SparkSession, d: str) -> DataFrame:
    return X.document_folds(O.passages(spark, d, "doc_id"), "grp", "doc_id", 4, "s3").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("grp").alias("n_groups"))


@query(f"""WITH {S.PASSAGES}, v AS (SELECT DISTINCT silver, doc_id FROM p WHERE silver IS NOT NULL), f AS (SELECT silver, doc_id, ((row_number() OVER (PARTITION BY silver ORDER BY md5(concat_ws('|', 's4', silver, doc_id)), doc_id) - 1) % 4)::INT k FROM v),
o AS (SELECT doc_id, arg_max(k, silver) AS fold FROM f GROUP BY 1) SELECT p.doc_id, fold, count(*) AS n FROM p JOIN o USING (doc_id) GROUP BY 1, 2""")  # fmt: skip
def value_doc_folds(spark: SparkSession, d: str) -> DataFrame:
    return X.value_document_folds(O.passages(spark, d, "doc_id", "silver"), "silver", "doc_id", 4, "s4").groupBy("doc_id", "fold").agg(F.count("*").alias("n"))


@query(f"WITH {S.PASSAGES}, c AS (SELECT doc_id, ntile(4) OVER (ORDER BY {S.order('s5', 'doc_id')}, doc_id) - 1 AS fold FROM (SELECT DISTINCT doc_id FROM p)) SELECT doc_id, fold::INT AS fold FROM c")
def even_chunks(spark: SparkSession, d: str) -> DataFrame:
    return X.even_chunks(O.passages(spark, d, "doc_id"), "doc_id", 4, "s5").select("doc_id", "fold").distinct()


_REG = f"""{S.PASSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {S.order('s6', 'provision_id')}, provision_id) k, count(*) OVER (PARTITION BY grp) n FROM p), h AS (SELECT grp AS held, count(*) AS hn FROM p WHERE grp IS NOT NULL GROUP BY 1),
b AS (SELECT h.held, h.hn, r.provision_id, r.doc_id, grp IS NOT DISTINCT FROM held AS mine, grp IS NOT DISTINCT FROM held AND k <= greatest(5, round(n * 0.3)) AS test FROM r, h), t AS (SELECT DISTINCT held, doc_id FROM b WHERE test),
c AS (SELECT b.*, t.doc_id IS NOT NULL AS tdoc, (SELECT count(*) FROM p) - hn AS z FROM b LEFT JOIN t ON t.held = b.held AND t.doc_id = b.doc_id),
e AS (SELECT *, row_number() OVER (PARTITION BY held, NOT test ORDER BY {S.order('s6-train', 'provision_id')}, provision_id) kr, row_number() OVER (PARTITION BY held, NOT test AND NOT tdoc ORDER BY {S.order('s6-train', 'provision_id')}, provision_id) kd FROM c),
g AS (SELECT held, provision_id, test, NOT test AND kr <= z AS train_random, NOT test AND NOT tdoc AND kd <= z AS train_doc, NOT mine AS train_group FROM e)"""


@query(f"WITH {_REG} SELECT held, count_if(test)::BIGINT AS n_test, count_if(train_random)::BIGINT AS n_random, count_if(train_doc)::BIGINT AS n_doc, count_if(train_group)::BIGINT AS n_group FROM g GROUP BY 1")
def regimes_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the test set and the three training sets, every group held out in turn."""
    r = _regimes(spark, d).groupBy("held")
    return r.agg(F.count_if("test").alias("n_test"), F.count_if("train_random").alias("n_random"), F.count_if("train_doc").alias("n_doc"), F.count_if("train_group").alias("n_group"))


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    return X.regimes(O.passages(spark, d, "doc_id"), "grp", "doc_id", "provision_id", 0.3, "s6")


@query(f"WITH {_REG} SELECT held, count_if(train_doc AND NOT train_group)::BIGINT AS doc_only, count_if(train_group AND NOT train_doc)::BIGINT AS group_only, count_if(train_doc AND NOT train_group) + count_if(train_group AND NOT train_doc) = 0 AS identical FROM g GROUP BY 1")
def regime_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether leaving out the test documents and leaving out the group give one training set, for every group."""
    a, b = F.count_if(F.col("train_doc") & ~F.col("train_group")), F.count_if(F.col("train_group") & ~F.col("train_doc"))
    return _regimes(spark, d).groupBy("held").agg(a.alias("doc_only"), b.alias("group_only"), (a + b == 0).alias("identical"))


@query(f"WITH {S.PASSAGES}, f AS (SELECT provision_id, silver, heading_path, ((row_number() OVER (PARTITION BY silver ORDER BY {S.order('s11', 'provision_id')}, provision_id) - 1) % 4)::INT AS fold FROM p) SELECT fold::BIGINT AS fold, count(*) AS n FROM (SELECT heading_path, min(fold) fold FROM f WHERE heading_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fold) = 1) GROUP BY 1")
def unseen_values(spark: SparkSession, d: str) -> DataFrame:
    """Heading paths that stand in one fold alone, so that a model of the other folds has never seen them."""
    f = X.stratified_folds(O.passages(spark, d, "silver", "heading_path"), "silver", "provision_id", 4, "s11")
    return X.unseen(f, "heading_path", "fold").select(F.col("fold").cast("bigint").alias("fold"), "n")


@query(f"WITH {S.PASSAGES}, f AS (SELECT grp, doc_id, ((row_number() OVER (PARTITION BY grp ORDER BY {S.order('s12', 'doc_id')}, doc_id) - 1) % 4)::INT AS df FROM (SELECT DISTINCT grp, doc_id FROM p)), n AS (SELECT df, (SELECT count(*) FROM p) - count(*) AS left_ FROM p JOIN f USING (grp, doc_id) GROUP BY 1), k AS (SELECT ((row_number() OVER (PARTITION BY grp ORDER BY {S.order('s12', 'provision_id')}, provision_id) - 1) % 4)::INT AS fold FROM p), r AS (SELECT fold, (SELECT count(*) FROM k) - count(*) AS most FROM k GROUP BY 1) SELECT df::BIGINT AS fold, least(left_, most) AS n_train FROM n JOIN r ON r.fold = n.df")
def matched_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of every fold of rows when it is cut to what the fold of documents leaves."""
    df = X.document_folds(O.passages(spark, d, "doc_id"), "grp", "doc_id", 4, "s12", "doc_fold")
    rows = X.matched_folds(df, "grp", "doc_fold", "provision_id", 4, "s12")
    return rows.select(F.posexplode(F.array(*[F.col(f"train_{f}") for f in range(4)])).alias("fold", "t")).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count_if("t").alias("n_train"))


@query(f"WITH {S.PASSAGES}, v AS (SELECT grp, count(*) AS n_docs FROM (SELECT grp, doc_id FROM p GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT grp, n_docs, (SELECT min(n_docs) FROM (SELECT n_docs FROM v ORDER BY n_docs DESC LIMIT 4) HAVING count(*) = 4)::BIGINT AS deepest FROM v")
def deepest_dose(spark: SparkSession, d: str) -> DataFrame:
    """The groups with most documents of five passages or more, and how many documents four of them have."""
    k, first = X.deepest_dose(O.passages(spark, d, "doc_id"), "grp", "doc_id", 5)
    return first.withColumn("deepest", F.lit(k).cast("bigint"))


@query(f"""WITH {S.PASSAGES}, c AS (SELECT silver, doc_id FROM p GROUP BY 1, 2 HAVING count(*) >= 5), k AS (SELECT silver, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY silver ORDER BY md5(concat_ws('|', 's7', silver, doc_id)), doc_id) r FROM c) WHERE r <= 4),
a AS (SELECT p.silver, p.doc_id, provision_id, row_number() OVER (PARTITION BY p.silver, p.doc_id ORDER BY {S.order('s7', 'provision_id')}, provision_id) q FROM p JOIN k ON k.silver = p.silver AND k.doc_id = p.doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY silver ORDER BY q, {S.order('s7', 'provision_id')}, provision_id) t FROM a WHERE q <= 5), x AS (SELECT * FROM b WHERE t <= 20)
SELECT silver, doc_id, provision_id FROM x WHERE silver IN (SELECT silver FROM x GROUP BY 1 HAVING count(*) = 20 AND count(DISTINCT doc_id) = 4)""")  # fmt: skip
def dose_draw(spark: SparkSession, d: str) -> DataFrame:
    return X.dose_draw(O.passages(spark, d, "silver", "doc_id"), "silver", "doc_id", "provision_id", 4, 20, "s7").select("silver", "doc_id", "provision_id")


@query(f"""WITH {S.PASSAGES}, k AS (SELECT grp, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', 's8', grp, doc_id)), doc_id) r FROM (SELECT DISTINCT grp, doc_id FROM p)) WHERE r <= 2)
SELECT grp, provision_id FROM (SELECT p.grp, provision_id, row_number() OVER (PARTITION BY p.grp ORDER BY {S.order('s8', 'provision_id')}, provision_id) r FROM p JOIN k ON k.grp = p.grp AND k.doc_id = p.doc_id) WHERE r <= 25""")  # fmt: skip
def pool_draw(spark: SparkSession, d: str) -> DataFrame:
    return X.pool_draw(O.passages(spark, d, "doc_id"), "grp", "doc_id", "provision_id", 2, 25, "s8").select("grp", "provision_id")


@query(f"""WITH {S.PASSAGES}, h AS (SELECT provision_id, silver, row_number() OVER (ORDER BY {S.order('s9', 'provision_id')}, provision_id) i, {S.order('s9', 'provision_id')} h FROM p),
s AS (SELECT provision_id k, CASE WHEN ('0x' || substr({S.order('s9-shown', 'provision_id')}, 1, 8))::BIGINT / 4294967296.0 < 0.67 THEN silver END sug, h, i::DOUBLE place, NULL rep FROM h UNION ALL SELECT provision_id, NULL, h, i + 220.5, provision_id FROM h WHERE i <= 50)
SELECT row_number() OVER (ORDER BY place, h, k) - 1 AS i, k AS key, sug AS suggested, rep AS repeat_of FROM s""")  # fmt: skip
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    q = X.review_queue(O.passages(spark, d, "silver"), "provision_id", F.col("silver"), 0.67, 50, 220, "s9")
    return q.select(F.col("i").cast("bigint").alias("i"), "key", "suggested", "repeat_of")


@query(f"""WITH {S.PASSAGES}, x AS (SELECT rep, grp, domain, silver, row_number() OVER (PARTITION BY rep, grp, domain ORDER BY md5(concat_ws('|', 's10', rep, provision_id)), provision_id) k FROM p, (SELECT unnest(range(200))::INT rep) WHERE domain IS NOT NULL AND silver IS NOT NULL)
SELECT rep, grp, domain, silver, count(*) AS n FROM x WHERE k <= 10 GROUP BY 1, 2, 3, 4""")  # fmt: skip
def equal_draws(spark: SparkSession, d: str) -> DataFrame:
    rows = O.passages(spark, d, "domain", "silver").where("domain is not null and silver is not null")
    return X.equal_draws(rows, ["grp", "domain"], "provision_id", 10, 200, "s10").groupBy("rep", "grp", "domain", "silver").agg(F.count("*").alias("n"))
