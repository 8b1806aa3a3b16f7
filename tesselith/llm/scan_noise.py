"""Problem 4: traces of the scanned page in text, and clean paragraphs.

Words are grouped by their skeleton, in which glyphs that scanners confuse fall together; in each group frequent
forms are words and a rare form that follows from one by confusions is a misreading. Where it follows from several,
its neighbours in all texts tell which of them is meant. A word broken
over two lines is joined if its joined form is supported by the words of the corpus and its hyphenated form is
not. Running headers are lines that equal, digits masked, a title of the corpus; page numbers are lines of
nothing but a number. SQL windows over the remaining lines put the text back into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.llm.residue import Detector
from tesselith.plans.lineage import materialise, release
from tesselith.sources.tables import table

# What is printed and what a scanner reads instead.
CONFUSIONS = (
    ("e", "c"), ("c", "("), ("o", "0"), ("a", "o"), ("s", "5"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("i", "l"), ("n", "u"), ("h", "b"), ("t", "f"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("li", "h"), ("in", "m"),
)

# The glyph by which each class of confusable glyphs is known.
CLASSES = {"(": "c", "e": "c", "0": "o", "a": "o", "5": "s", "1": "l", "!": "l", "i": "l", "u": "n", "b": "h", "6": "h", "8": "h", "9": "g", "f": "t", "2": "z"}

#: Texts that hold a word before it counts as known, and how many times rarer a misreading is than its word.
KNOWN, RARER = 3, 8

#: Known forms and misreadings that are broadcast; with more, each text's words are joined with them instead, but for
#: the most frequent forms, which every text has.
BROADCAST_FORMS, FREQUENT = 2_000_000, 50_000

_SOFT = "­¬‐"
# A mark before a word may be its first letter, unless it opens a bracket that is closed.
_FORM = re.compile(r"(?:(?<![A-Za-z0-9])(?:\((?![^()\n]{0,80}\))|!)(?=[a-z]))?[A-Za-z0-9][A-Za-z0-9!(]*[A-Za-z0-9!(]|[A-Za-z]")
_HAS_LETTER = re.compile(r"[A-Za-z]")
_NEXT = re.compile(r"([A-Za-z0-9!(]+)([-­¬‐])[ \t\r]*$")
_FIRST = re.compile(r"^[ \t]*([A-Za-z0-9!(]+)")
_MAY_BREAK = re.compile(r"[\u00ad¬‐]|-[ \t\r]*\n")
_SOFT_BREAK = re.compile(r"[A-Za-z][­¬‐]\s+[a-z]")

# Shapes of a line that is only a page number.
PAGE_NUMBER = re.compile(
    r"^\s*(?:(?:page|pg\.?|p\.)\s*\d{1,5}(?:\s+of\s+\d{1,5})?|[-–—~]\s*\d{1,5}\s*[-–—~]|\[\s*\d{1,5}\s*\]|\d{1,5}|\d{1,3}-\d{1,4}|[ivxlc]{1,7}|[*|]\s*\d{1,5}\s*[*|])\s*$", re.I
)
_ROMAN = re.compile(r"^(?=[ivxlc])(?:xc|xl|l?x{0,3}|c{1,3})?(?:ix|iv|v?i{0,3})$")
_DECOR = re.compile(r"^[\s*=~|#-]+|[\s*=~|#-]+$")
# Words in lower case inside titles.
_SMALL = frozenset("of the and in on for to a an cont'd continued".split())
_CONT = re.compile(r"\s*\(\s*cont(?:inue|')?d\.?\s*\)\s*$|\s*[-–,]?\s*continued\s*$", re.I)


# What separates words; brackets that open, exclamation marks and hyphens may belong to one.
_SEPARATORS = {ord(c): " " for c in ".,;:\"'“”‘’)[]{}<>/\\|?*~=+&%$#@^`—–…\u00ad¬‐"}


def rough_forms(text: str) -> set[str]:
    """Quickly, the words of a text and the parts of hyphenated ones; a superset of its misreadings up to opening brackets."""
    words = set(text.lower().translate(_SEPARATORS).split())
    for w in [w for w in words if "-" in w]:
        words.update(w.split("-"))
    return words


def forms(text: str) -> list[str]:
    """Words of a text as read, lower-cased, with digits and marks that stand for letters inside them."""
    return [w for w in _FORM.findall(text.lower()) if _HAS_LETTER.search(w)]


# Pairs of glyphs that are read as one, and the pairs read as one that are also common in real words.
_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"))
_COMMON_PAIRS = (("l!", "h"), ("li", "h"), ("1i", "h"), ("in", "m"), ("1n", "m"), ("!n", "m"), ("ln", "m"))


def skeletons(word: str) -> list[str]:
    """The word with confusable glyphs made equal, with no, few and all pairs taken as one; a misreading shares one of them."""
    few = word
    for two, one in _PAIRS:
        few = few.replace(two, one)
    every = few
    for two, one in _COMMON_PAIRS:
        every = every.replace(two, one)
    return sorted({f"{k}{''.join(CLASSES.get(c, c) for c in w)}" for k, w in enumerate((word, few, every))})


def follows(word: str, read: str, most: int = 3) -> bool:
    """Whether ``read`` comes from ``word`` by at most ``most`` confusions (and is not ``word``)."""
    if word == read or abs(len(word) - len(read)) > most:
        return False
    best = {0: {0: 0}}  # places in word -> places in read -> confusions so far
    for i in range(len(word)):
        for j, n in best.get(i, {}).items():
            if j < len(read) and word[i] == read[j]:
                row = best.setdefault(i + 1, {})
                row[j + 1] = min(n, row.get(j + 1, most + 1))
            if n < most:
                for a, b in CONFUSIONS:
                    if word.startswith(a, i) and read.startswith(b, j):
                        row = best.setdefault(i + len(a), {})
                        row[j + len(b)] = min(n + 1, row.get(j + len(b), most + 1))
    return len(read) in best.get(len(word), {})


def mask(line: str) -> str:
    """Digits as one mark, case and white space aside."""
    return " ".join(re.sub(r"\d+", "#", line).lower().split())


def vocabulary(texts: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """(word, n): in how many texts each form occurs. Hyphenated compounds count as forms of their own.

    Each partition counts first; only distinct forms are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(rough_forms(t))
            if len(counts) > 500_000:
                yield _counts(counts)
                counts = Counter()
        yield _counts(counts)

    parts = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string, n bigint")
    if headings is not None:
        parts = parts.unionAll(headings.select(F.explode(F.split(F.lower("heading_path"), r"[^a-z0-9!(]+")).alias("word"), F.lit(1).cast("bigint").alias("n")))
    return parts.where("word rlike '^[a-z0-9!(]+$' and word rlike '[a-z]' or word rlike '^[a-z]+(-[a-z]+)+$'").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def neighbours(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, side, other, n): how often each of ``words`` (word) stands next to each other word in all texts, by side.

    Each partition counts first. The list of words is broadcast if it is small, else all neighbours are counted and joined with it.
    """
    few = words.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
    sent = texts.sparkSession.sparkContext.broadcast({r.word for r in words.toLocalIterator()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counts = sent.value, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                row = t.lower().translate(_SEPARATORS).split()
                if asked is not None and asked.isdisjoint(row):
                    continue
                for i, w in enumerate(row):
                    if asked is None or w in asked:
                        if i:
                            counts[w, "l", row[i - 1]] += 1
                        if i + 1 < len(row):
                            counts[w, "r", row[i + 1]] += 1
            if len(counts) > 500_000:
                yield made(counts)
                counts = Counter()
        yield made(counts)

    def made(counts: Counter) -> pa.RecordBatch:
        cols = list(zip(*counts)) if counts else [[]] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(counts.values()), pa.int64())], ["word", "side", "other", "n"])

    got = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string, side string, other string, n bigint").groupBy("word", "side", "other").agg(F.sum("n").alias("n"))
    return got if few else got.join(words, "word", "left_semi")


def misreadings(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(reading, word): forms that are misreadings, with the frequent form of their skeleton from which they follow.

    All frequent forms of a skeleton are tried; one that is a misreading itself stands for its word. Of several words the
    one is meant whose neighbours in all texts are most like those of the reading (naive Bayes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([skeletons(w) for w in b.column(0).to_pylist()], pa.list_(pa.string()))], ["word", "n", "skels"])

    # More marks than letters is a code, not a word.
    plain_forms = words.where("word not like '%-%' and length(word) > 1 and length(regexp_replace(word, '[^a-z]', '')) >= length(regexp_replace(word, '[a-z]', ''))")
    held = materialise(plain_forms.mapInArrow(run, "word string, n bigint, skels array<string>").select("word", "n", F.explode("skels").alias("skel")), "skeletons")
    leads = held.where((F.col("n") >= KNOWN) & ~F.col("word").rlike(r"[0-9!(]"))
    pair = held.alias("x").join(leads.alias("y"), "skel").where("y.n >= %d * x.n or (x.word rlike '[0-9!(]' and y.n >= x.n)" % RARER).where("x.word <> y.word")
    pair = pair.select(F.col("x.word").alias("reading"), F.col("y.word").alias("word"), F.col("y.n").alias("n")).distinct()  # words share several skeletons

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (r, w) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if follows(w, r)]
            yield b.take(pa.array(keep, pa.int64()))

    ok = materialise(pair.mapInArrow(check, "reading string, word string, n bigint"), "readings")
    best = F.max_by(F.struct("word", "n"), F.struct("n", "word"))
    own = ok.groupBy(F.col("reading").alias("word")).agg(best.alias("m")).select("word", F.col("m.word").alias("for"), F.col("m.n").alias("m"))
    ok = ok.join(own, "word", "left").select("reading", F.coalesce("for", "word").alias("word"), F.coalesce("m", "n").alias("n")).where("reading <> word").distinct()
    choice = materialise(ok.withColumn("words", F.count("*").over(Window.partitionBy("reading"))), "choices")
    several = choice.where("words > 1")
    asked = materialise(several.select(F.col("reading").alias("word")).union(several.select("word")).distinct(), "asked")
    near = materialise(neighbours(texts, asked), "neighbours")
    # What stands beside the reading, and how often beside each word that it may be.
    beside = several.join(near.select(F.col("word").alias("reading"), "side", "other", F.col("n").alias("m")), "reading")
    beside = beside.join(near.withColumnRenamed("n", "c"), ["word", "side", "other"], "left")
    fit = beside.groupBy("reading", "word").agg(F.sum(F.col("m") * (F.log(F.coalesce("c", F.lit(0)) + 0.5) - F.log(F.col("n") + 1.0))).alias("fit"))
    scored = choice.join(fit, ["reading", "word"], "left").withColumn("fit", F.coalesce("fit", F.lit(0.0)) + F.log("n"))
    out = materialise(scored.groupBy("reading").agg(F.max_by("word", F.struct("fit", "n", "word")).alias("word")), "misreadings")
    for done in (held, choice, asked, near):
        release(done)
    return out


def titles(corpus: DataFrame) -> DataFrame:
    """(title, n): masked titles that pages of the corpus carry: of documents, with and without the nation, and of headings.

    ``n`` counts distinct paths, not pages, so a title of a document with one heading path has 1 and is as good as any.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\d+", "#"), r"\s+", " ")
    whole = corpus.select(plain(F.col("doc_title")).alias("title"), plain(F.col("nation")).alias("nation"), F.split(plain(F.col("heading_path")), " > ").alias("path")).distinct()
    parts = whole.select(F.explode(F.concat(F.array("title", F.concat_ws(" ", F.split("nation", " ")[0], "title"), F.concat_ws(" ", "nation", "title")), F.coalesce("path", F.array()))).alias("title"))
    return parts.where("length(title) > 3").groupBy("title").agg(F.count("*").alias("n"))


class Reader:
    """Finds the traces in one text, given what the corpus knows."""

    def __init__(self, wrong: dict[str, str], known: set[str], compounds: set[str], heads: set[str]):
        self.wrong, self.known, self.compounds, self.heads = wrong, known, compounds, heads
        self._residue = Detector()
        self._paths: dict[str, bool] = {}

    def is_header(self, line: str) -> bool:
        bare = line.strip()
        if not 3 < len(bare) <= 120 or bare[-1] in ".,;:" or len(words := bare.split()) > 16:
            return False
        # Titles are capitalised throughout: most lines end here.
        if not all(w[0] in "*=~|#-–(&" or not w[0].islower() or w in _SMALL for w in words):
            return False
        bare = _CONT.sub("", _DECOR.sub("", bare))
        if mask(bare) in self.heads:
            return True
        parts = [mask(p) for p in re.split(r"\s{2,}|\s+[|]\s+", bare)]
        return all([p in self.heads or " ".join(self.right(w) for w in p.split()) in self.heads for p in parts])  # a list: all are asked at once

    def right(self, word: str) -> str:
        return self.wrong.get(word, word)

    @staticmethod
    def is_page_number(line: str) -> bool:
        if len(line) > 60 or not PAGE_NUMBER.match(line):
            return False
        bare = line.strip().lower()
        return _ROMAN.match(bare) is not None if bare.isalpha() else True

    def joins(self, left: str, mark: str, right: str) -> bool:
        """Whether a word was broken between two pieces."""
        if mark in _SOFT:
            return True
        left, right = left.lower(), right.lower()
        one, two = left + right, f"{self.right(left)}-{self.right(right)}"
        if two in self.compounds:
            return False
        if one in self.known or one in self.wrong:
            return True
        return not (self.right(left) in self.known and self.right(right) in self.known)

    def lines(self, text: str) -> list[tuple[str, str]]:
        """(kind, line): text, running_header, page_number or empty."""
        rows = text.split("\n")
        several = len(rows) > 1
        out = []
        for line in rows:
            if not line.strip():
                out.append(("empty", line))
            elif several and self.is_page_number(line):
                out.append(("page_number", line))
            elif several and self.is_header(line):
                out.append(("running_header", line))
            else:
                out.append(("text", line))
        return out

    def body(self, text: str) -> tuple[set[str], str]:
        """(kinds found, text whose traces are repaired, line by line)."""
        kinds, kept = set(), []
        typed = self.lines(text) if "\n" in text else [("text", text)]
        odd_line = any(kind in ("page_number", "running_header") for kind, _ in typed)
        if not odd_line and not _MAY_BREAK.search(text) and self.wrong.keys().isdisjoint(rough_forms(text)):
            return kinds, text  # most texts
        for kind, line in typed:
            if kind in ("page_number", "running_header"):
                kinds.add(kind)
            else:
                kept.append(line.rstrip())
        joined: list[str] = []
        for line in kept:
            m = _NEXT.search(joined[-1]) if joined else None
            if m and not line.strip():
                continue  # a gap where a header or number stood
            n = _FIRST.match(line) if m else None
            if m and n and n.group(1)[0].islower() and self.joins(m.group(1), m.group(2), n.group(1)):
                kinds.add("hyphen_break")
                joined[-1] = joined[-1][: m.end(1)] + line.lstrip()
            else:
                joined.append(line)
        out = "\n".join(joined)
        if _SOFT_BREAK.search(out):
            kinds.add("hyphen_break")
            out = re.sub(r"(?<=[A-Za-z])[­¬‐]\s+(?=[a-z])", "", out)
        wrong = self.wrong

        def repair(m: re.Match) -> str:
            word = m.group()
            good = wrong.get(word.lower())
            if good is None:
                return word
            kinds.add("char_misread")
            return good.upper() if word.isupper() and len(word) > 1 else good.capitalize() if word[0].isupper() else good

        if not wrong.keys().isdisjoint(_FORM.findall(out.lower())):
            out = _FORM.sub(repair, out)
        return kinds, out

    def heading(self, path: str | None) -> bool:
        return bool(path) and any(w in self.wrong for w in forms(path))

    def __call__(self, text: str | None, path: str | None) -> tuple[list[str], str | None]:
        kinds, out = self.body(text) if text else (set(), text)
        if path and path not in self._paths:
            if len(self._paths) > 200_000:
                self._paths.clear()
            self._paths[path] = self.heading(path)
        if path and self._paths[path]:
            kinds.add("heading_misread")
        if kinds and text is not None and self._residue(text):
            return [], text
        return sorted(kinds), out


def learn(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the corpus knows: words (word, n), misreadings (reading, word), compounds (word) and titles (title)."""
    words = materialise(vocabulary(corpus, corpus.where(F.col("heading_path").isNotNull()).select("heading_path")), "words")
    wrong = misreadings(words, corpus)
    known = words.where((F.col("n") >= KNOWN) & ~F.col("word").contains("-")).join(wrong.select(F.col("reading").alias("word")), "word", "left_anti")
    # A compound counts if it stands unbroken at least as often as its joined form.
    both = words.where("word like '%-%' and n >= 2").select(F.col("word").alias("compound"), F.regexp_replace("word", "-", "").alias("word"), F.col("n").alias("m"))
    compounds = both.join(words, "word", "left").where("n is null or m >= n").select(F.col("compound").alias("word"))
    return materialise(known, "known"), wrong, materialise(compounds, "compounds"), materialise(titles(corpus).select("title"), "titles")


_READ = "provision_id string, kinds array<string>, repaired string"


def _found(ids: list, kinds: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], ["provision_id", "kinds", "repaired"])


def read(corpus: DataFrame, most: int = BROADCAST_FORMS) -> DataFrame:
    """(provision_id, kinds, repaired): one row for each row of ``corpus`` that carries a trace of the scanned page.

    Null and blank texts carry only heading traces; texts with template residue carry none; rows with null ids
    have no row; repeated rows stay repeated; whole texts are read; an empty table gives an empty table. What the
    corpus knows is broadcast up to ``most`` forms and titles, else looked up by a join with the same result.
    """
    known, wrong, compounds, heads = learn(corpus)
    rows = corpus.where(F.col("provision_id").isNotNull()).select("provision_id", "text", "heading_path")
    if known.count() + wrong.count() + compounds.count() + heads.count() > most:
        return _read_by_join(rows, known, wrong, compounds, heads)
    knows = corpus.sparkSession.sparkContext.broadcast((
        {r.reading: r.word for r in wrong.toLocalIterator()}, {r.word for r in known.select("word").toLocalIterator()}, {r.word for r in compounds.toLocalIterator()}, {r.title for r in heads.toLocalIterator()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*knows.value)
        for b in batches:
            got = [(i, *reader(t, p)) for i, t, p in zip(*(c.to_pylist() for c in b.columns))]
            got = [g for g in got if g[1]]
            yield _found(*(list(c) for c in zip(*got))) if got else _found([], [], [])

    return rows.mapInArrow(run, _READ)


class _Told:
    """What the corpus knows of one kind, as far as a text was told it; a question not asked before is noted in ``open`` and means no for now."""

    def __init__(self, kind: str, told: dict[str, tuple], often: set[str], open_: set[str], mark: str = ""):
        self.kind, self.told, self.often, self.open, self.mark = kind, told, often, open_, mark

    def get(self, x: str, other: str | None = None) -> str | None:
        if x in self.often:
            return x if self.kind == "known" else other
        if (got := self.told.get(self.mark + x)) is None:
            self.open.add(self.mark + x)
            return other
        return (got[1] or x) if got[0] == self.kind else other

    def __contains__(self, x: str) -> bool:
        return self.get(x) is not None

    def keys(self) -> _Told:
        return self

    def isdisjoint(self, words: Iterable[str]) -> bool:
        return not any([w in self for w in words])  # all are asked at once


def _read_by_join(rows: DataFrame, known: DataFrame, wrong: DataFrame, compounds: DataFrame, heads: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size: the reader notes what it asks of each text, a join answers, and it reads again.

    Answers lead to other questions (a line or a word whose misreadings are corrected), so texts with open
    questions go round again; a text is settled by a reading in which every question had its answer.
    """
    often = {r.word for r in known.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").collect()}  # a fixed number
    sent = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader({}, set(), set(), set())
        for b in batches:
            got = []
            for i, t, p, facts in zip(*(c.to_pylist() for c in b.columns)):
                told, open_ = {f["q"]: (f["kind"], f["v"]) for f in facts or []}, set()
                reader.wrong, reader.known, reader.compounds = (_Told(k, told, sent.value, open_) for k in ("wrong", "known", "compound"))
                reader.heads = _Told("head", told, frozenset(), open_, "#")
                reader._paths.clear()
                kinds, clean = reader(t, p)
                if open_:
                    got.append((i, t, p, None, None, sorted(open_)))
                elif kinds:
                    got.append((i, None, None, kinds, clean, []))
            cols = list(zip(*got)) if got else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_of)], names)

    names = ["provision_id", "text", "heading_path", "kinds", "repaired", "open"]
    kinds_of = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
    shape = "provision_id string, text string, heading_path string, kinds array<string>, repaired string, open array<string>"
    none = F.lit(None).cast("string")
    answers = known.select(F.col("word").alias("q"), F.lit("known").alias("kind"), none.alias("v")).unionAll(wrong.select("reading", F.lit("wrong"), "word"))
    answers = answers.unionAll(compounds.select("word", F.lit("compound"), none)).unionAll(heads.select(F.concat(F.lit("#"), "title"), F.lit("head"), none))

    # First what each text asks; the loop reads all of them, those without a question too.
    asked = rows.withColumn("told", F.lit(None).cast("array<struct<q:string,kind:string,v:string>>")).mapInArrow(run, shape).select("provision_id", F.explode("open").alias("q")).distinct()
    facts, settled, todo = None, None, rows
    while True:
        new = materialise(asked.join(answers, "q", "left").select("provision_id", "q", "kind", "v"), "facts")  # a row for no, too: it is not asked again
        facts = new if facts is None else facts.unionAll(new)
        told = facts.groupBy("provision_id").agg(F.collect_list(F.struct("q", "kind", "v")).alias("told"))  # at most a text's own words
        got = materialise(todo.join(told, "provision_id", "left").select("provision_id", "text", "heading_path", "told").mapInArrow(run, shape), "read")
        done = got.where("size(open) = 0").select("provision_id", "kinds", "repaired")
        settled = done if settled is None else settled.unionAll(done)
        todo = got.where("size(open) > 0").select("provision_id", "text", "heading_path", "open")
        if todo.isEmpty():
            return settled
        asked, todo = todo.select("provision_id", F.explode("open").alias("q")).distinct(), todo.drop("open")


def reflow(found: DataFrame) -> DataFrame:
    """(provision_id, paragraph, text): continuous paragraphs by windows over the repaired lines.

    A paragraph begins after an empty line, at a list mark, or at a line that follows a sentence's end and a short line.
    """
    lines = found.dropDuplicates(["provision_id"]).select("provision_id", F.posexplode(F.split("repaired", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    w = Window.partitionBy("provision_id").orderBy("pos")
    before = F.lag("line").over(w)
    begins = before.isNull() | (before == "") | F.col("line").rlike(r"^(\([a-z0-9]{1,4}\)|[0-9]+\.|[-*•])\s") | (before.rlike(r"[.:;!?]$") & (F.length(before) < 40))
    numbered = lines.withColumn("begins", begins).withColumn("paragraph", F.sum(F.col("begins").cast("int")).over(w)).where("line <> ''")
    whole = numbered.groupBy("provision_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return whole.select("provision_id", "paragraph", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").select("provision_id", "text", "heading_path", "doc_title", "nation")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provisions with traces of the scanned page, one row for each kind."""
    return read(_corpus(spark, sf_dir)).select("provision_id", F.explode("kinds").alias("kind")).distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean paragraphs of those provisions."""
    return reflow(read(_corpus(spark, sf_dir)))
