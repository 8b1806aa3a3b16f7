"""From the text of a document to its passages: lines, contents, headings, sections, titles, numbers.

Everything is windows over the lines of a document; a document is the most that one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import passages as O

#: Letters of a body, lines of contents that make a table, and sections under which titles are tried instead.
BODY, CONTENTS_RUN, FEW = (40, 12_000), 4, 3

_MARKS = " .:–-"


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, off, line): every line with the place of its first letter in the text; null texts have none."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return O.lines_of(df, key, text).withColumn("off", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("bigint"))


def without_contents(rows: DataFrame, key: str, least: int = CONTENTS_RUN) -> DataFrame:
    """Lines outside tables of contents (``least`` index lines in a run) and their captions; places stay those of the whole text."""
    flagged = rows.withColumn("_flag", T.contents_line(F.col("line"))).withColumn("_blank", F.trim("line") == "")
    kept = O.islands(flagged, key, "pos", "_flag", "_blank", least).where(~F.col("drop"))
    return kept.where(~F.trim("line").rlike(f"(?i){P.CONTENTS_HEAD}")).drop("_flag", "_blank", "drop")


def headings(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, off, level, label): the larger units that open at a line; a unit without a name takes the next line's, if that reads as one."""
    w = Window.partitionBy(key).orderBy("pos")
    bare = lambda c: F.btrim(c, F.lit(_MARKS))
    one, two = (bare(F.coalesce(F.lead("line", k).over(w), F.lit(""))) for k in (1, 2))
    near = F.when(one != "", one).otherwise(two)
    name = F.when(near.rlike(r"^[A-Z0-9]") & ~near.rlike(r"[.;,]$") & (T.n_words(near) <= 12), T.squash(near)).otherwise("")
    unit, number, rest = (F.regexp_extract("line", P.UNIT_LINE, k) for k in (1, 2, 3))
    at = rows.select(key, "pos", "off", "line", name.alias("_next")).where(F.col("line").rlike(P.UNIT_LINE))
    own = T.squash(bare(rest))
    level = F.coalesce(*[F.when(unit == k, v) for k, v in P.UNITS.items()])
    return at.select(key, "pos", "off", level.alias("level"), F.trim(F.concat_ws(" ", F.initcap(F.lower(unit)), number, F.when(own != "", own).otherwise(F.col("_next")))).alias("label"))


def _joined() -> Column:
    """The lines of a group as one text, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_l"))), lambda x: x["_l"]), "\n")


def sections(rows: DataFrame, key: str) -> DataFrame:
    """(key, off, section, heading, text, history): what stands between a section's opener and the next one.

    Bodies of 40 to 12,000 letters that read as enacted stay; a short first line without a final mark is the heading;
    notes in brackets are taken out.
    """
    line = F.col("line")
    number = F.coalesce(F.nullif(F.regexp_extract(line, P.OPENER, 1), F.lit("")), F.nullif(F.regexp_extract(line, P.BARE_OPENER, 1), F.lit("")))
    rest = F.when(line.rlike(P.OPENER), F.regexp_replace(line, P.OPENER, "")).otherwise(F.regexp_replace(line, rf"^[ \t]*{P.NUMBER}[ \t]*[.:–][ \t]+", ""))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_no", number).withColumn("_l", F.when(F.col("_no").isNotNull(), rest).otherwise(line)).withColumn("_k", F.count("_no").over(w)).where("_k > 0")
    body = marked.groupBy(key, "_k").agg(F.min("off").alias("off"), F.min_by("_no", "pos").alias("section"), T.strip(_joined()).alias("body"))
    body = body.where(F.length("body").between(*BODY))
    first = F.trim(F.substring_index("body", "\n", 1))
    titled = F.col("body").contains("\n") & (F.length(F.substring_index("body", "\n", 1)) < 120) & (first != "") & ~first.rlike(r"[.;:]$") & (T.n_words(first) <= 14)
    split = body.select(key, "off", "section", F.when(titled, first).otherwise("").alias("heading"), F.when(titled, T.strip(F.regexp_replace("body", r"^[^\n]*\n", ""))).otherwise(F.col("body")).alias("text"))
    return split.where(T.substantive(F.col("text"))).withColumn("history", T.history_note(F.col("text"))).withColumn("text", T.strip(T.without_history(F.col("text"))))


def titles(rows: DataFrame, key: str) -> DataFrame:
    """(key, off, section, heading, text, history) of texts whose sections have titles and no numbers: a title line stands over a line of five words or more."""
    w = Window.partitionBy(key).orderBy("pos")
    t, after = F.trim("line"), F.trim(F.coalesce(F.lead("line").over(w), F.lit("")))
    is_title = t.rlike(P.TITLE_LINE) & T.n_words(t).between(2, 10) & (t != F.upper(t)) & after.rlike(r"^[A-Z0-9“\"(]") & ~after.rlike(r"^[a-z]") & (T.n_words(after) >= 5)
    marked = rows.withColumn("_t", F.when(is_title, t)).withColumn("_k", F.count("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_k > 0").withColumn("_l", F.when(F.col("_t").isNull(), F.col("line")))
    body = marked.groupBy(key, "_k").agg(F.min("off").alias("off"), F.min_by("_t", "pos").alias("heading"), T.strip(_joined()).alias("text"))
    none = F.lit(None).cast("string")
    return body.where(T.substantive(F.col("text"))).select(key, "off", F.lit("").alias("section"), "heading", "text", none.alias("history"))


def provisions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, provision_id, seq, off, section, heading, text, history, path, deepest, unnumbered): the passages of every document.

    Tables of contents are left out. A document with fewer than three numbered sections takes its titled ones if they
    are more. Of passages alike in their first 220 letters the first stays; they are numbered in order.
    """
    rows = without_contents(lines(df, key, text), key)
    numbered, titled = sections(rows, key).withColumn("unnumbered", F.lit(False)), titles(rows, key).withColumn("unnumbered", F.lit(True))
    both = numbered.unionByName(titled)
    n = both.groupBy(key).agg(F.count_if(~F.col("unnumbered")).alias("_a"), F.count_if("unnumbered").alias("_b"))
    chosen = both.join(n.select(key, ((F.col("_a") < FEW) & (F.col("_b") > F.col("_a"))).alias("_alt")), key).where("unnumbered = _alt").drop("_alt")
    first = O.first_wins(chosen.withColumn("_key", T.text_key(F.col("text"), 220)), [key, "_key"], ["off"]).drop("_key")
    empty = F.lit(None)
    events = headings(rows, key).select(key, "off", "level", "label", F.lit(False).alias("_s"))
    placed = O.heading_stack(events.unionByName(first.select(key, "off", empty.cast("int").alias("level"), empty.cast("string").alias("label"), F.lit(True).alias("_s"))), key, "off", "level", "label")
    out = first.join(placed.where("_s").select(key, "off", "path", "deepest"), [key, "off"])
    seq = F.row_number().over(Window.partitionBy(key).orderBy("off")) - 1
    return out.withColumn("seq", seq.cast("bigint")).withColumn("provision_id", F.concat_ws("-", F.col(key), F.format_string("%04d", "seq")))
