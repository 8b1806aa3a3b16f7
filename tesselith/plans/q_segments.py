"""Queries: documents cut into passages. Codes are the passages of a document set as one text, with contents, headings and openers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import passages as O
from tesselith.operators import segments as G
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


def codes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): every document of the corpus as a published code."""
    p = O.passages(spark, d, "doc_id", "char_offset", "section", "heading", "heading_path", "text")
    w = Window.partitionBy("doc_id").orderBy("char_offset", "provision_id")
    unit = lambda part, sep: F.concat(F.upper(F.regexp_extract(part, r"^([A-Za-z]+) ", 1)), F.lit(" "), F.regexp_extract(part, r"^[A-Za-z]+ +(\S+)", 1), F.lit(sep), F.regexp_extract(part, r"^[A-Za-z]+ +\S+ *(.*)$", 1))
    parts = F.split("heading_path", " > ")
    heads = F.concat_ws("\n", unit(F.get(parts, F.lit(0)), "\n"), F.transform(F.slice(parts, 2, 9), lambda x: unit(x, " ")))
    new = F.col("heading_path").isNotNull() & ~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w))
    opener = F.concat(F.lit("Section "), T.blank(F.col("section")), F.lit(". "), T.blank(F.col("heading")))
    row = p.select("doc_id", F.row_number().over(w).alias("k"), F.concat_ws("\n", F.when(new, heads), opener, "text").alias("block"), opener.alias("entry"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), "\n")
    return row.groupBy("doc_id").agg(F.concat(F.lit("TABLE OF CONTENTS\n"), joined("entry"), F.lit("\n\nText of the code\n"), joined("block")).alias("text"))


_UNIT = "upper(regexp_extract({0}, '^([A-Za-z]+) ', 1)) || ' ' || regexp_extract({0}, '^[A-Za-z]+ +(\\S+)', 1) || {1} || regexp_extract({0}, '^[A-Za-z]+ +\\S+ *(.*)$', 1)"
_OPENED = "'Section ' || coalesce(section, '') || '. ' || coalesce(heading, '')"
_CODES = f"""{S.PASSAGES}, b AS (SELECT doc_id, row_number() OVER w AS k, {_OPENED} AS entry, concat_ws(chr(10), CASE WHEN heading_path IS NOT NULL AND heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN
  concat_ws(chr(10), {_UNIT.format("string_split(heading_path, ' > ')[1]", 'chr(10)')}, nullif(array_to_string([{_UNIT.format('x', "' '")} FOR x IN string_split(heading_path, ' > ')[2:]], chr(10)), '')) END, {_OPENED}, text) AS block
  FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY char_offset, provision_id)),
src AS (SELECT doc_id, 'TABLE OF CONTENTS' || chr(10) || string_agg(entry, chr(10) ORDER BY k) || chr(10) || chr(10) || 'Text of the code' || chr(10) || string_agg(block, chr(10) ORDER BY k) AS text FROM b GROUP BY 1)"""
_DOCS = "src AS (SELECT doc_id, text FROM documents)"
_TAIL = "trim(regexp_replace(regexp_replace(trim(line), '(?i)" + P.SECTION_LINE + "', '', 'g'), '^[ .:–-]+|[ .:–-]+$', '', 'g'))"
_TOC = f"(trim(line) <> '' AND (regexp_matches(trim(line), '{P.DOT_LEADER}') OR (length(trim(line)) <= 95 AND regexp_matches(trim(line), '(?i){P.SECTION_LINE}') AND ({S.n_words(_TAIL)}) <= 9 AND NOT regexp_matches(trim(line), '[.;:]$'))))"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_W = f"string_split({S.squash('coalesce({0}, ' + chr(39) * 2 + ')')}, ' ')"


def _enacted(c: str) -> str:
    w = _W.format(c)
    return f"len({w}) >= 12 AND NOT regexp_matches({c}, '{P.DOT_LEADER}') AND len(list_filter({w}, lambda x: length(x) > 2 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) * 1.0 / len({w}) <= 0.55 AND {S.rx(c, P.VERB_CUE)}"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_LINES = f"""l0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM src WHERE text IS NOT NULL),
l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, {_TOC} AS flag, trim(line) = '' AS blank FROM l0),
l2 AS (SELECT *, sum(CASE WHEN flag OR blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l1),
l3 AS (SELECT *, min(CASE WHEN flag THEN pos END) OVER (PARTITION BY doc_id, run) AS first, sum(flag::INT) OVER (PARTITION BY doc_id, run) AS flags FROM l2),
l AS (SELECT doc_id, pos, off, line FROM l3 WHERE NOT coalesce((flag OR blank) AND pos >= first AND flags >= {G.CONTENTS_RUN}, false) AND NOT regexp_matches(trim(line), '(?i){P.CONTENTS_HEAD}'))"""
_LEVEL = "CASE u " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.UNITS.items()) + " END"
_BARE = "trim({0}, ' .:–-')"
_HEADS = f"""h0 AS (SELECT doc_id, pos, off, line, {_BARE.format("coalesce(lead(line, 1) OVER w, '')")} AS n1, {_BARE.format("coalesce(lead(line, 2) OVER w, '')")} AS n2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h1 AS (SELECT doc_id, pos, off, regexp_extract(line, '{_q(P.UNIT_LINE)}', 1) AS u, regexp_extract(line, '{_q(P.UNIT_LINE)}', 2) AS no, {S.squash(_BARE.format(f"regexp_extract(line, '{_q(P.UNIT_LINE)}', 3)"))} AS own, CASE WHEN n1 <> '' THEN n1 ELSE n2 END AS near FROM h0 WHERE regexp_matches(line, '{_q(P.UNIT_LINE)}')),
h AS (SELECT doc_id, pos, off, {_LEVEL} AS level, trim(upper(u[1]) || lower(u[2:]) || ' ' || no || ' ' || CASE WHEN own <> '' THEN own WHEN regexp_matches(near, '^[A-Z0-9]') AND NOT regexp_matches(near, '[.;,]$') AND ({S.n_words('near')}) <= 12 THEN {S.squash('near')} ELSE '' END) AS label FROM h1)"""
_NO = f"coalesce(nullif(regexp_extract(line, '{P.OPENER}', 1), ''), nullif(regexp_extract(line, '{P.BARE_OPENER}', 1), ''))"
_SECTIONS = f"""s0 AS (SELECT *, {_NO} AS no, CASE WHEN regexp_matches(line, '{P.OPENER}') THEN regexp_replace(line, '{P.OPENER}', '') WHEN regexp_matches(line, '{P.BARE_OPENER}') THEN regexp_replace(line, '^[ \t]*{P.NUMBER}[ \t]*[.:–][ \t]+', '') ELSE line END AS t FROM l),
s1 AS (SELECT *, count(no) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s0),
s2 AS (SELECT doc_id, k, min(off) AS off, min_by(no, pos) AS section, {_STRIP.format('string_agg(t, chr(10) ORDER BY pos)')} AS body FROM s1 WHERE k > 0 GROUP BY 1, 2),
s3 AS (SELECT *, split_part(body, chr(10), 1) AS f FROM s2 WHERE length(body) BETWEEN {G.BODY[0]} AND {G.BODY[1]}),
s4 AS (SELECT *, contains(body, chr(10)) AND length(f) < 120 AND trim(f) <> '' AND NOT regexp_matches(trim(f), '[.;:]$') AND ({S.n_words('f')}) <= 14 AS titled FROM s3),
s5 AS (SELECT doc_id, off, section, CASE WHEN titled THEN trim(f) ELSE '' END AS heading, CASE WHEN titled THEN {_STRIP.format("regexp_replace(body, '^[^' || chr(10) || ']*' || chr(10), '')")} ELSE body END AS body FROM s4),
s AS (SELECT doc_id, off, section, heading, nullif(trim(regexp_extract(body, '(?is){P.HISTORY}', 1)), '') AS history, {_STRIP.format(f"trim(regexp_replace(body, '(?is){P.HISTORY}', '', 'g'))")} AS text, false AS unnumbered FROM s5 WHERE {_enacted('body')})"""
_TITLES = f"""t0 AS (SELECT *, trim(line) AS t, trim(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '')) AS nx FROM l),
t1 AS (SELECT *, CASE WHEN regexp_matches(t, '{_q(P.TITLE_LINE)}') AND ({S.n_words('t')}) BETWEEN 2 AND 10 AND t <> upper(t) AND regexp_matches(nx, '^[A-Z0-9“"(]') AND ({S.n_words('nx')}) >= 5 THEN t END AS ti FROM t0),
t2 AS (SELECT *, count(ti) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t1),
t3 AS (SELECT doc_id, k, min(off) AS off, min_by(ti, pos) AS heading, {_STRIP.format("coalesce(string_agg(CASE WHEN ti IS NULL THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM t2 WHERE k > 0 GROUP BY 1, 2),
t AS (SELECT doc_id, off, '' AS section, heading, NULL AS history, body AS text, true AS unnumbered FROM t3 WHERE {_enacted('body')})"""
_ALL = f"""c0 AS (SELECT * FROM s UNION ALL SELECT * FROM t), n AS (SELECT doc_id, count_if(NOT unnumbered) AS a, count_if(unnumbered) AS b FROM c0 GROUP BY 1),
c1 AS (SELECT c0.* FROM c0 JOIN n USING (doc_id) WHERE unnumbered = (a < {G.FEW} AND b > a)),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY doc_id, substr(regexp_replace(lower(text), '[^a-z0-9_]+', '', 'g'), 1, 220) ORDER BY off) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS seq FROM c2)"""


@query(f"WITH {_CODES}, {_LINES} SELECT doc_id, count(*) AS n_lines, min(off) AS first_off, sum(length(line))::BIGINT AS n_letters FROM l GROUP BY 1")
def contents_removed(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every code that stay when its table of contents is taken out."""
    rows = G.without_contents(G.lines(codes(spark, d), "doc_id"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("off").alias("first_off"), F.sum(F.length("line")).alias("n_letters"))


@query(f"WITH {_CODES}, {_LINES}, {_HEADS} SELECT doc_id, off, level::BIGINT AS level, label FROM h")
def heading_events(spark: SparkSession, d: str) -> DataFrame:
    rows = G.without_contents(G.lines(codes(spark, d), "doc_id"), "doc_id")
    return G.headings(rows, "doc_id").select("doc_id", "off", F.col("level").cast("bigint").alias("level"), "label")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "off", "section", "heading", F.md5("text").alias("text"), "history")


@query(f"WITH {_CODES}, {_LINES}, {_SECTIONS} SELECT doc_id, off, section, heading, md5(text) AS text, history FROM s")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sections of the codes."""
    return _shown(G.sections(G.without_contents(G.lines(codes(spark, d), "doc_id"), "doc_id"), "doc_id"))


@query(f"WITH {_CODES}, {_LINES}, {_TITLES} SELECT doc_id, off, section, heading, md5(text) AS text, history FROM t")
def title_segments(spark: SparkSession, d: str) -> DataFrame:
    """Titled sections of the codes."""
    return _shown(G.titles(G.without_contents(G.lines(codes(spark, d), "doc_id"), "doc_id"), "doc_id"))


@query(f"WITH {_DOCS}, {_LINES}, {_SECTIONS}, {_TITLES}, {_ALL} SELECT doc_id, seq, off, section, heading, md5(text) AS text, unnumbered FROM c")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """The passages of the longer texts, numbered or else titled."""
    got = G.provisions(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return got.select("doc_id", "seq", "off", "section", "heading", F.md5("text").alias("text"), "unnumbered")


_STACK = ", ".join(f"max(CASE WHEN level = {k} THEN off END) OVER w AS p{k}, arg_max(CASE WHEN level = {k} THEN label END, CASE WHEN level = {k} THEN off END) OVER w AS l{k}" for k in range(4))
_LIVE = [f"CASE WHEN p{k} IS NOT NULL" + "".join(f" AND coalesce(p{j}, -1) <= p{k}" for j in range(k)) + f" THEN l{k} END" for k in range(4)]


@query(f"""WITH {_CODES}, {_LINES}, {_HEADS}, {_SECTIONS}, {_TITLES}, {_ALL}, e AS (SELECT doc_id, off, level, label FROM h UNION ALL SELECT doc_id, off, NULL, NULL FROM c),
k AS (SELECT *, {_STACK} FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c.doc_id || '-' || lpad(seq::VARCHAR, 4, '0') AS provision_id, section, c.heading, concat_ws(' > ', {', '.join(_LIVE)}) AS path FROM c JOIN k ON k.doc_id = c.doc_id AND k.off = c.off AND k.level IS NULL""")  # fmt: skip
def provision_ids(spark: SparkSession, d: str) -> DataFrame:
    """The passages cut from the codes, with their numbers and the headings above them."""
    return G.provisions(codes(spark, d), "doc_id").select("provision_id", "section", "heading", "path")
