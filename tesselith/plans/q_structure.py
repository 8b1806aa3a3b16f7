"""Queries: lines, headings, segments, near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import diffusion as D
from tesselith.operators import passages as O
from tesselith.operators import related
from tesselith.operators import resample as R
from tesselith.plans import sqltext as S
from tesselith.plans.lineage import materialise
from tesselith.sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = "l AS (SELECT provision_id, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM p WHERE text IS NOT NULL)"
_TAIL = "trim(regexp_replace(regexp_replace(trim(line), '(?i)" + P.SECTION_LINE + "', '', 'g'), '^[ .:–-]+|[ .:–-]+$', '', 'g'))"
_TOC = f"(trim(line) <> '' AND (regexp_matches(trim(line), '{P.DOT_LEADER}') OR (length(trim(line)) <= 95 AND regexp_matches(trim(line), '(?i){P.SECTION_LINE}') AND ({S.n_words(_TAIL)}) <= 9 AND NOT regexp_matches(trim(line), '[.;:]$'))))"


@query(f"WITH {S.PASSAGES}, {_LINES} SELECT provision_id, pos::BIGINT AS pos FROM l WHERE {_TOC}")
def contents_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.lines_of(O.passages(spark, d, "text"), "provision_id").where(T.contents_line(F.col("line"))).select("provision_id", F.col("pos").cast("bigint").alias("pos"))


_SHORT = "(length(trim(line)) <= 24)"


@query(f"""WITH {S.PASSAGES}, {_LINES}, f AS (SELECT provision_id, pos, trim(line) <> '' AND {_SHORT} AS flag, trim(line) = '' AS blank FROM l),
r AS (SELECT *, sum(CASE WHEN flag OR blank THEN 0 ELSE 1 END) OVER (PARTITION BY provision_id ORDER BY pos) AS run FROM f),
m AS (SELECT *, min(CASE WHEN flag THEN pos END) OVER (PARTITION BY provision_id, run) AS first, sum(flag::INT) OVER (PARTITION BY provision_id, run) AS flags FROM r)
SELECT provision_id, pos::BIGINT AS pos FROM m WHERE (flag OR blank) AND pos >= first AND flags >= 3""")  # fmt: skip
def toc_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three short lines: the island operator that drops tables of contents, on a flag that the data has."""
    lines = O.lines_of(O.passages(spark, d, "text"), "provision_id")
    t = F.trim("line")
    flagged = lines.select("provision_id", "pos", ((t != "") & (F.length(t) <= 24)).alias("flag"), (t == "").alias("blank"))
    return O.islands(flagged, "provision_id", "pos", "flag", "blank", 3).where("drop").select("provision_id", F.col("pos").cast("bigint").alias("pos"))


_MASKED = "regexp_replace(trim(line), '[0-9]+', '#', 'g')"


@query(f"""WITH {S.PASSAGES}, l AS (SELECT provision_id, doc_id, unnest(string_split(concat_ws(chr(10), replace(heading_path, ' > ', chr(10)), text), chr(10))) AS line FROM p WHERE text IS NOT NULL),
k AS (SELECT doc_id, {_MASKED} AS masked, count(DISTINCT provision_id) AS n_pages FROM l WHERE length({_MASKED}) > 3 AND length({_MASKED}) < 90 GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS pages FROM p WHERE text IS NOT NULL GROUP BY 1)
SELECT doc_id, masked, n_pages FROM k JOIN n USING (doc_id) WHERE n_pages >= greatest(3, 0.35 * pages)""")  # fmt: skip
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur, digits masked, on many pages of one document; a page is a passage under its headings."""
    p = O.passages(spark, d, "doc_id", "heading_path", "text").where("text is not null")
    pages = p.groupBy("doc_id").agg(F.count("*").alias("pages"))
    line = F.regexp_replace(F.trim("line"), "[0-9]+", "#")
    page = F.concat_ws("\n", F.replace("heading_path", F.lit(" > "), F.lit("\n")), "text")
    rows = p.select("doc_id", "provision_id", F.explode(F.split(page, "\n")).alias("line")).select("doc_id", "provision_id", line.alias("masked"))
    counts = rows.where("length(masked) > 3 and length(masked) < 90").distinct().groupBy("doc_id", "masked").agg(F.count("*").alias("n_pages"))
    return counts.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(3), 0.35 * F.col("pages"))).select("doc_id", "masked", "n_pages")


_EVENTS = """x AS (SELECT doc_id, char_offset * 10 + 1 AS pos, NULL::INT AS level, NULL AS label, provision_id FROM p
UNION ALL SELECT doc_id, min(char_offset) * 10 - 1, 0, string_split(heading_path, ' > ')[1], NULL FROM p WHERE heading_path IS NOT NULL GROUP BY doc_id, string_split(heading_path, ' > ')[1]
UNION ALL SELECT doc_id, min(char_offset) * 10, 1, chapter, NULL FROM p WHERE chapter IS NOT NULL GROUP BY doc_id, chapter, coalesce(string_split(heading_path, ' > ')[1], ''))"""


@query(f"""WITH {S.PASSAGES}, {_EVENTS}, w AS (SELECT *, max(CASE WHEN level = 0 THEN pos END) OVER v p0, max(CASE WHEN level = 1 THEN pos END) OVER v p1 FROM (SELECT DISTINCT ON (doc_id, pos, level) * FROM x WHERE level IS NOT NULL ORDER BY doc_id, pos, level, label) WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT doc_id, pos, level, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, level ORDER BY label) k FROM x WHERE level IS NOT NULL) WHERE k = 1),
s AS (SELECT x.provision_id, (SELECT max(pos) FROM e WHERE e.doc_id = x.doc_id AND level = 0 AND e.pos <= x.pos) p0, (SELECT max(pos) FROM e WHERE e.doc_id = x.doc_id AND level = 1 AND e.pos <= x.pos) p1, x.doc_id FROM x WHERE provision_id IS NOT NULL)
SELECT s.provision_id, concat_ws(' > ', a.label, CASE WHEN coalesce(p0, -1) <= p1 THEN b.label END) AS path, coalesce(CASE WHEN coalesce(p0, -1) <= p1 THEN b.label END, a.label, '') AS deepest
FROM s LEFT JOIN e a ON a.doc_id = s.doc_id AND a.level = 0 AND a.pos = p0 LEFT JOIN e b ON b.doc_id = s.doc_id AND b.level = 1 AND b.pos = p1""")  # fmt: skip
def heading_asof(spark: SparkSession, d: str) -> DataFrame:
    """Headings in force at every passage, resolved from heading events by place."""
    p = O.passages(spark, d, "doc_id", "char_offset", "heading_path", "chapter")
    title = F.get(F.split("heading_path", " > "), F.lit(0))
    none = F.lit(None).cast("string")
    sections = p.select("doc_id", (F.col("char_offset") * 10 + 1).alias("pos"), F.lit(None).cast("int").alias("level"), none.alias("label"), "provision_id")
    titles = p.where("heading_path is not null").groupBy("doc_id", title.alias("label")).agg((F.min("char_offset") * 10 - 1).alias("pos"))
    chapters = p.where("chapter is not null").groupBy("doc_id", F.col("chapter").alias("label"), F.coalesce(title, F.lit("")).alias("t")).agg((F.min("char_offset") * 10).alias("pos"))
    events = titles.select("doc_id", "pos", F.lit(0).alias("level"), "label", none.alias("provision_id")).unionByName(chapters.select("doc_id", "pos", F.lit(1).alias("level"), "label", none.alias("provision_id")))
    events = events.groupBy("doc_id", "pos", "level").agg(F.min("label").alias("label"), F.min("provision_id").alias("provision_id"))
    out = O.heading_stack(events.unionByName(sections), "doc_id", "pos", "level", "label", 2)
    return out.where("provision_id is not null").select("provision_id", "path", "deepest")


_WORDS = f"string_split({S.squash('coalesce(text, ' + chr(39) * 2 + ')')}, ' ')"


@query(f"SELECT doc_id, k::BIGINT AS k, array_to_string(w[k*60+1:k*60+60], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(0, len(w) // 60)) k FROM (SELECT doc_id, {_WORDS} w FROM documents))")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return O.word_windows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("k").cast("bigint").alias("k"), "passage")


@query(f"""WITH a AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n+') t FROM documents), s AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS k, unnest(t) AS part FROM a)
SELECT doc_id, k::BIGINT AS k, ({S.n_words('part')})::BIGINT AS words FROM s WHERE {S.n_words('part')} BETWEEN 25 AND 400""")  # fmt: skip
def paragraph_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(T.blank(F.col("text")), r"\n\s*\n+")).alias("k", "part"))
    words = T.n_words(F.col("part"))
    return parts.where(words.between(25, 400)).select("doc_id", F.col("k").cast("bigint").alias("k"), words.cast("bigint").alias("words"))


def _sh(w: str, k: int, short: str) -> str:
    return f"list_distinct([substr(md5(array_to_string({w}[i:i+{k - 1}], ' ')), 1, 16) for i in range(1, {short})])"


_DIFF = f"""{S.PASSAGES}, q AS (SELECT provision_id id, grp, {S.squash("lower(coalesce(text, ''))")} t FROM p), v AS (SELECT id, grp, string_split(t, ' ') w FROM q),
s AS (SELECT id, grp, {_sh('w', 9, 'greatest(len(w) - 8, 1) + 1')} s FROM v)"""
_PAIRS = f"""{_DIFF}, k AS (SELECT id, grp, unnest(list_sort(s)[1:60]) g FROM s), u AS (SELECT g FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), o AS (SELECT k.* FROM k JOIN u USING (g)),
c AS (SELECT DISTINCT x.id a, y.id b FROM o x JOIN o y ON x.g = y.g AND x.id < y.id AND x.grp <> y.grp),
j AS (SELECT a, b, x.grp grp_a, y.grp grp_b, len(list_intersect(x.s, y.s)) * 1.0 / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) j FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b)"""


@query(f"WITH {_DIFF} SELECT grp, count(*) AS n, sum(len(s))::BIGINT AS n_shingles FROM s GROUP BY 1")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.passages(spark, d, "text").select("grp", F.size(T.shingles(F.col("text"))).alias("k")).groupBy("grp").agg(F.count("*").alias("n"), F.sum("k").alias("n_shingles"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = O.passages(spark, d, "text").select("provision_id", "grp", T.shingles(F.col("text")).alias("s"), T.squash(F.lower(T.blank(F.col("text")))).alias("words"))
    return D.shared_pairs(rows, "provision_id", "grp", "s", at_least=0.7, words="words")


@query(f"WITH {_PAIRS} SELECT a, b, round(j, 8) AS j FROM j WHERE j >= 0.8")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("j >= 0.8").select("a", "b", F.round("j", 8).alias("j"))


@query(f"WITH {_PAIRS} SELECT DISTINCT greatest(a, b) AS id FROM j WHERE j >= 0.8")
def near_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return D.later_of_pair(_pairs(spark, d).where("j >= 0.8"))


@query(f"WITH {_PAIRS}, t AS (SELECT unnest([0.7, 0.8, 0.9]) t), i AS (SELECT t, a id FROM j, t WHERE j >= t UNION SELECT t, b FROM j, t WHERE j >= t), n AS (SELECT t, count(*) n_pairs FROM j, t WHERE j >= t GROUP BY 1) SELECT t::DOUBLE AS threshold, n_pairs, (SELECT count(*) FROM i WHERE i.t = n.t) AS n_passages, round((SELECT count(*) FROM i WHERE i.t = n.t) * 1.0 / (SELECT count(*) FROM s), 8) AS share FROM n")
def near_dup_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One Jaccard table at the lowest threshold serves all."""
    steps = [0.7, 0.8, 0.9]
    pairs = materialise(_pairs(spark, d).where(F.col("j") >= steps[0]), "pairs").withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("j"))))
    ids = pairs.select("threshold", F.col("a").alias("id")).union(pairs.select("threshold", "b")).distinct().groupBy("threshold").agg(F.count("*").alias("n_passages"))
    total = O.passages(spark, d).agg(F.count("*").alias("total"))
    return pairs.groupBy("threshold").agg(F.count("*").alias("n_pairs")).join(ids, "threshold").crossJoin(F.broadcast(total)).select("threshold", "n_pairs", "n_passages", F.round(F.col("n_passages") / F.col("total"), 8).alias("share"))


@query(f"WITH {_PAIRS} SELECT least(grp_a, grp_b) AS one, greatest(grp_a, grp_b) AS two, count(*) AS n FROM j WHERE j >= 0.7 GROUP BY 1, 2")
def group_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("j >= 0.7").groupBy(F.least("grp_a", "grp_b").alias("one"), F.greatest("grp_a", "grp_b").alias("two")).agg(F.count("*").alias("n"))


#: Every pair of near sets: of each the first shingles, rare ones first, that can't all be missing from a set near it.
_WHOLE = f"""{_DIFF}, e AS (SELECT id, grp, len(s) n, unnest(s) g FROM s), f AS (SELECT g, count(*) m FROM e GROUP BY 1), o AS (SELECT id, grp, n, g FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY m, g) r FROM e JOIN f USING (g)) WHERE r <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT x.id a, y.id b FROM o x JOIN o y ON x.g = y.g AND x.id < y.id AND x.grp <> y.grp),
j AS (SELECT a, b, len(list_intersect(x.s, y.s)) * 1.0 / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) j FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b)"""


@query(f"WITH {_WHOLE}, i AS (SELECT a id FROM j WHERE j >= 0.7 UNION SELECT b FROM j WHERE j >= 0.7) SELECT grp, coalesce(domain, '-') AS dom, count(i.id) AS hits, count(*) AS total FROM p LEFT JOIN i ON i.id = p.provision_id GROUP BY 1, 2")
def reuse_rates(spark: SparkSession, d: str) -> DataFrame:
    """Passages with a near-duplicate elsewhere, by group and domain; however many passages hold a shingle, and wherever it stands."""
    words = T.squash(F.lower(T.blank(F.col("text"))))
    near = D.near_elsewhere(O.passages(spark, d, "text").withColumn("words", words), "provision_id", "grp", "words", 0.7).withColumn("hit", F.lit(1))
    rows = O.passages(spark, d, "text", "domain").select("grp", F.coalesce("domain", F.lit("-")).alias("dom"), F.when(F.col("grp").isNotNull(), F.md5(words)).alias("text"))
    counts = rows.groupBy("grp", "dom", "text").agg(F.count("*").alias("n"))  # copies combine before they are looked up
    return counts.join(near, "text", "left").groupBy("grp", "dom").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits"), F.sum("n").alias("total"))


@query(f"""WITH {_PAIRS}, near AS (SELECT a id FROM j WHERE j >= 0.8 UNION SELECT b FROM j WHERE j >= 0.8), rate AS (SELECT grp, avg((near.id IS NOT NULL)::INT) FILTER (WHERE domain = 'civil') - avg((near.id IS NOT NULL)::INT) FILTER (WHERE domain = 'criminal') AS diff FROM p LEFT JOIN near ON near.id = p.provision_id GROUP BY 1),
gap AS (SELECT grp, diff FROM rate WHERE diff IS NOT NULL), flip AS (SELECT rep, sum(CASE WHEN substr(md5(concat_ws('|', 'd1', rep, grp)), 1, 1) < '8' THEN diff ELSE -diff END) t FROM gap, (SELECT unnest(range(5000)) rep) GROUP BY 1), obs AS (SELECT sum(diff) d, count(*) n FROM gap)
SELECT n, round(d / n, 8) AS mean, round((1 + (SELECT count(*) FROM flip, obs WHERE abs(t) >= abs(d) - 1e-12)) / 5001.0, 8) AS p FROM obs""")  # fmt: skip
def reuse_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Share of passages with a near-duplicate elsewhere, civil less criminal inside each group, with a sign-flip test."""
    ids = D.involved(_pairs(spark, d).where("j >= 0.8")).select(F.col("id").alias("provision_id"), F.lit(1).alias("hit"))
    rows = O.passages(spark, d, "domain").join(ids, "provision_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    rate = lambda x: F.avg(F.when(F.col("domain") == x, F.col("hit")))
    got = R.sign_flip(rows.groupBy("grp").agg((rate("civil") - rate("criminal")).alias("diff")), "grp", "diff", 5000, "d1")
    return got.select("n", F.round("mean", 8).alias("mean"), F.round("p", 8).alias("p"))


@query(f"""WITH RECURSIVE h AS (SELECT DISTINCT lower(trim(doc_id)) src, lower(trim(reprint_of)) dst FROM harvest_docs WHERE reprint_of IS NOT NULL AND lower(trim(doc_id)) <> lower(trim(reprint_of))),
seeds AS (SELECT DISTINCT src AS node FROM h WHERE src NOT IN (SELECT dst FROM h)),
r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT h.dst, r.depth + 1 FROM r JOIN h ON h.src = r.node WHERE r.depth < 3)
SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1""")  # fmt: skip
def frontier_walk(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first walk of bounded depth over stored links, here of reprints."""
    links = table(spark, d, "harvest_docs").where("reprint_of is not null").select(F.lower(F.trim("doc_id")).alias("src"), F.lower(F.trim("reprint_of")).alias("dst")).where("src <> dst").distinct()
    seeds = links.select("src").distinct().join(links.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("node"))
    return related.walk(links, seeds, 3).select("node", F.col("depth").cast("bigint").alias("depth"))




@query(f"""WITH a AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n(Sec\\. [0-9])', chr(1) || '\\1', 'g'), chr(1)) t FROM documents), s AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS k, unnest(t) AS part FROM a)
SELECT doc_id, k::BIGINT AS k, ({S.n_words('part')})::BIGINT AS words FROM s WHERE k > 0 AND {S.n_words('part')} BETWEEN 25 AND 400""")  # fmt: skip
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Sections of 25 to 400 words, split before their openers; what stands before the first opener is left out."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(T.blank(F.col("text")), r"\n(?=Sec\. [0-9])")).alias("k", "part"))
    words = T.n_words(F.col("part"))
    return parts.where((F.col("k") > 0) & words.between(25, 400)).select("doc_id", F.col("k").cast("bigint").alias("k"), words.cast("bigint").alias("words"))


_WORDS_OF = "regexp_extract_all(lower(coalesce(doc_title, '') || ' ' || coalesce(source_url, '')), '[a-z]+')"


@query(f"""WITH {S.PASSAGES}, n AS (SELECT regexp_extract(grp, '[a-z]+') AS word, min(grp) AS name FROM p WHERE regexp_matches(grp, '[a-z]') GROUP BY 1), w AS (SELECT provision_id, unnest({_WORDS_OF}) AS word FROM p),
h AS (SELECT provision_id, name, count(*) AS hits FROM w JOIN n USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER v AS k, lead(hits) OVER v AS second FROM h WINDOW v AS (PARTITION BY provision_id ORDER BY hits DESC, name))
SELECT provision_id, name, hits FROM r WHERE k = 1 AND hits >= 2 * coalesce(second, 0)""")  # fmt: skip
def dominant_name(spark: SparkSession, d: str) -> DataFrame:
    """The group most named in a passage's title and address, if named twice as often as any other."""
    p = O.passages(spark, d, "doc_title", "source_url")
    return O.dominant_name(p, "provision_id", F.concat_ws(" ", "doc_title", "source_url"), p.where(F.col("grp").rlike("[a-z]")), "grp", 1, 2)
