"""Nulls, empty and long texts, ties, repeats, empty tables and clashing extra columns; results against brute force."""

import os
import random
import re

import numpy as np
import pandas as pd
import pytest

from tesselith.llm import grouping, mixing, neardup, phrases, proportions, related_splits, residue, scan_noise, split_overlap, subjects, tokenizer
from tesselith.plans import lineage

WORDS = "court judge clerk order notice bond fine council member hearing record appeal motion file seal village river school water road house tax vote game".split()


def words_of(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def phrase_set(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 30 else set()


def some_texts(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randrange(4)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = [r.choice(WORDS)] * r.randrange(2)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(WORDS) + r.choice(["", "s", str(r.randrange(40))]) for _ in range(r.randrange(20, 90))))
    return out


# Problem 1 -----------------------------------------------------------------------------------------------------


def test_sample_meets_targets_and_floors(spark):
    rows = [(f"p{i}", "A " if i % 10 else "b", None if i % 3 == 0 else "x") for i in range(300)] + [("p1", "A ", "x"), (None, "A", "x")]
    recs = spark.createDataFrame(rows, "provision_id string, kind string, other string").withColumnRenamed("other", "_key")
    goals = spark.createDataFrame([("r", "kind", "a", 0.6, 1, 0.5), ("r", "kind", "B", 0.02, 12, 0.5), ("r", "kind", "none", 0.38, 2, 0.5), ("r", "kind", "B", 0.02, 12, 0.5)],
                                  "request_id string, field_name string, category string, target_share double, min_rows int, sample_fraction double")
    sample, report = proportions.draw(recs, goals, ("kind",))
    got = {r.category: r for r in report.collect()}
    assert got["a"].available == 270 and got["a"].drawn in (90, 91) and not got["a"].short
    assert got["B"].drawn == 12 and got["B"].available == 30  # the floor is repaired
    assert got["none"].short and got["none"].drawn == 0
    ids = [r.provision_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) and sum(r.added_by == "floor" for r in sample.collect()) >= 8


def test_sample_of_nothing(spark):
    goals = spark.createDataFrame([("r", "kind", "a", 0.5, 1, 1.0)], "request_id string, field_name string, category string, target_share double, min_rows int, sample_fraction double")
    sample, report = proportions.draw(spark.createDataFrame([], "provision_id string, kind string"), goals, ("kind",))
    assert sample.count() == 0 and [r.short for r in report.collect()] == [True]
    few = spark.createDataFrame([(f"p{i}", "a") for i in range(9)], "provision_id string, kind string")
    whole = spark.createDataFrame([("r", "kind", "a", 1.0, 1, 1.0), ("s", "kind", "a", 1.0, 12, 0.1), ("t", "kind", "a", 1.0, 9, 0.1)], goals.schema)
    assert {r.request_id: (r.drawn, r.short) for r in proportions.draw(few, whole, ("kind",))[1].collect()} == {"r": (9, False), "s": (9, True), "t": (9, False)}
    assert proportions.draw(spark.createDataFrame([("p", None)], "provision_id string, kind string"), goals.limit(0), ("kind",))[1].count() == 0


# Problem 2 -----------------------------------------------------------------------------------------------------


def test_overlap_equals_brute_force(spark):
    texts = some_texts(160, 3)
    rows = [(f"k{i:03}", t, i % 4 == 0) for i, t in enumerate(texts)] + [("k000", texts[0], True), ("n1", None, True), ("n2", "  ", False), (None, texts[0], False), ("n3", texts[1], None)]
    found, members = split_overlap.overlaps(spark.createDataFrame(rows, "key string, text string, asks boolean"))
    reps = {}
    for m in members.collect():
        reps.setdefault((m.asks, m.rep), set()).add(m.key)
    got = {(a, b) for r in found.collect() for a in reps[True, r.rep_a] for b in reps[False, r.rep_b]}
    s = {k: phrase_set(t) for k, t, _ in rows if k}
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a and b and x and y is False and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a])}
    assert got == want and len(want) > 20
    assert all(0 <= r.coverage <= 1 for r in found.collect())


def test_overlap_of_nothing(spark):
    found, members = split_overlap.overlaps(spark.createDataFrame([], "key string, text string, asks boolean"))
    assert found.count() == 0 and members.count() == 0


def test_chain_is_collinear():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert list(split_overlap.chain(np.array([0, 1, 2, 3]), np.array([5, 1, 2, 3]))) == [1, 2, 3]
    assert split_overlap.align(a, a)[1].all() and not split_overlap.align(a, a + np.uint64(9))[1].any()
    assert split_overlap.contains(a, a, 0.8) == (5, 5, split_overlap.align(a, a)[0], 1.0) and split_overlap.contains(a, a[:3], 0.8) is None
    assert split_overlap.contains(a, a[::-1], 0.8)[1] == 5  # the sets decide where the chain falls short


def test_scattered_texts_lose_no_overlap(spark):
    """Phrases of an evaluation text that lie scattered in the training text, exactly 80 % of them or one less; and texts that repeat a few words."""
    r, rows = random.Random(12), []
    vocabulary = [f"w{i}" for i in range(90)]
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.choice((34, 34, 44, 64)))]
        places = len(words) - 4
        lost = places // 5 + (i % 3 == 0)
        keep = sorted(r.sample(range(places), places - lost))
        blocks, at = [], 0
        while at < len(keep):  # runs of kept phrases, in any order, with other words between
            to = at
            while to + 1 < len(keep) and keep[to + 1] == keep[to] + 1 and r.random() < 0.7:
                to += 1
            blocks.append(words[keep[at] : keep[to] + 5])
            at = to + 1
        r.shuffle(blocks)
        rows += [(f"q{i:03}", " ".join(words), True), (f"t{i:03}", " ".join(f"{' '.join(b)} x{i}y{k}" for k, b in enumerate(blocks)), False)]
    for i in range(40):  # hardly any phrase follows another one for the first time
        few = [r.choice("ab") for _ in range(r.randrange(30, 90))]
        rows += [(f"r{i:03}", " ".join(few), True), (f"s{i:03}", " ".join(few[10:] + [r.choice("abc") for _ in range(9)]), False)]
    found, members = split_overlap.overlaps(spark.createDataFrame(rows, "key string, text string, asks boolean"))
    reps = {}
    for m in members.collect():
        reps.setdefault((m.asks, m.rep), set()).add(m.key)
    got = {(a, b) for x in found.collect() for a in reps[True, x.rep_a] for b in reps[False, x.rep_b]}
    s = {k: phrase_set(t) for k, t, _ in rows}
    want = {(a, b) for a, _, x in rows for b, _, y in rows if x and not y and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a])}
    assert got == want and len({a for a, _ in want if a[0] == "q"}) >= 95 and any(a[0] == "r" for a, _ in want)


# Problem 3 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [5, 1000])
def test_groups_equal_brute_force(spark, cell):
    r = random.Random(5)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(60) if i % 17] + [("hub", f"w{i}") for i in range(40)] + [(f"x{r.randrange(50)}", f"x{r.randrange(50)}") for _ in range(30)] + [("v1", "v1"), (None, "v2"), ("v2", None)]
    edges += [(b, a) for a, b in edges[:5]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.v: x.root for x in grouping.components(spark.createDataFrame([(*e, 1) for e in edges], "a string, b string, root int"), cell_edges=cell).collect()}
    assert got == {v: find(v) for v in parent}


def test_every_size_takes_the_grid(spark, monkeypatch):
    seen = []
    plain = grouping.materialise
    monkeypatch.setattr(grouping, "materialise", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    path = random.Random(8).sample(range(200), 200)
    n = grouping.components(spark.createDataFrame([(f"v{i:03}", f"v{j:03}") for i, j in zip(path, path[1:])], "a string, b string")).select("root").distinct().count()
    assert n == 1 and sum(name == "stars" for name, _ in seen) > 1  # cells exchanged what they found


def test_groups_of_nothing(spark):
    assert grouping.components(spark.createDataFrame([("a", "a")], "a string, b string")).count() == 0


# Problem 4 -----------------------------------------------------------------------------------------------------

CLEAN = "The court shall keep the record of every hearing and the clerk must mail a copy to each party within twenty-five days after judgment"


def noisy(spark, text, path="Title 4 Civil Actions > Chapter 2 Service"):
    rows = [(f"c{i}", CLEAN.replace("copy", f"copy number {i}"), "Title 4 Civil Actions > Chapter 2 Service", "Civil Code", "Orrisk Nation") for i in range(12)]
    rows += [("t", text, path, "Civil Code", "Orrisk Nation"), ("n", None, None, None, None), (None, "x", None, None, None), ("e", "", None, None, None), ("l", "court " * 20000, None, None, None)]
    df = spark.createDataFrame(rows, "provision_id string, text string, heading_path string, doc_title string, nation string")
    return {r.provision_id: r for r in scan_noise.read(df.withColumn("kinds", df.text)).collect()}


def test_traces_are_found_and_repaired(spark):
    got = noisy(spark, "The c0urt shall keep the re-\ncord of every hear­\ning and\nOrrisk Civil Code\nthe clerk must\n- 14 -\nmail a copy to tbe party within twenty-\nfive days", "Title 4 Civi1 Actions > Chapter 2 Service")
    assert set(got) == {"t"}
    assert got["t"].kinds == ["char_misread", "heading_misread", "hyphen_break", "page_number", "running_header"]
    flat = " ".join(got["t"].repaired.split())
    assert flat == "The court shall keep the record of every hearing and the clerk must mail a copy to the party within twenty- five days"


def test_join_and_broadcast_agree(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "FREQUENT", 4)
    rows = [(f"c{i}", CLEAN.replace("copy", f"copy number {i}"), "Title 4 Civil Actions > Chapter 2 Service", "Civil Code", "Orrisk Nation") for i in range(12)]
    rows += [("t", "The c0urt shall keep the re-\ncord of tbe\nOrrisk Civil Code\nhear-\n\n 12 \ning and twenty-\nfive days", "Title 4 Civi1 Actions", "Civil Code", "Orrisk Nation")] * 2 + [("n", None, None, None, None)]
    df = spark.createDataFrame(rows, "provision_id string, text string, heading_path string, doc_title string, nation string")
    one, two = (sorted(map(tuple, scan_noise.read(df, most).collect())) for most in (10**6, 0))
    assert one == two and len(one) == 2 and len(one[0][1]) == 5


def test_join_and_broadcast_agree_on_misread_lines(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "FREQUENT", 4)
    rows = [(f"c{i}", CLEAN.replace("copy", f"copy number {i} in twenty-five hearings"), "Title 4 Civil Actions > Chapter 2 Service", "Civil Code", "Orrisk Nation") for i in range(12)]
    texts = {"header": "The court shall\nTitle 4 Civll Actlons\nkeep the record", "two": "The court shall\nCivil Code  Chaptcr 2 Servicc\nkeep the record", "piece": "The record of twcnty-\nfive hearings",
             "far": "The court shall keep the re-\nCivil Code\n- 1 -\nCivil Code\n- 2 -\nCivil Code\ncord of it", "chain": "keep a judg-\nme-\nnt of it", "soft": "the judg\u00ad mcnt of it", "rare": "the zorb-\nlat of it"}
    rows += [(k, t, "Title 4 Civil Actions", "Civil Code", "Orrisk Nation") for k, t in texts.items()] + [("header", "Other judgmcnt of the clerk", None, None, None), ("n", None, None, None, None)]
    df = spark.createDataFrame(rows, "provision_id string, text string, heading_path string, doc_title string, nation string")
    one, two = (sorted(map(tuple, scan_noise.read(df, most).collect())) for most in (10**6, 0))
    assert one == two and {"far", "chain", "soft", "rare"} <= {r[0] for r in one} and {("header", "The court shall\nkeep the record"), ("two", "The court shall\nkeep the record"), ("soft", "the judgment of it")} <= {(r[0], r[2]) for r in one}


def test_header_of_a_document_with_one_heading_path(spark):
    rows = [(f"c{i}", CLEAN, "Title 4 Civil Actions", "Civil Code", "Orrisk Nation") for i in range(12)] + [("t", "The court shall keep\nTuvessa Law Code\nthe record", "Chapter 9 Fees", "Law Code", "Tuvessa Tribe")]
    df = spark.createDataFrame(rows, "provision_id string, text string, heading_path string, doc_title string, nation string")
    assert [(r.provision_id, r.kinds, r.repaired) for r in scan_noise.read(df).collect()] == [("t", ["running_header"], "The court shall keep\nthe record")]


def test_clean_text_has_no_trace(spark):
    assert noisy(spark, CLEAN.replace("record of", "record\nof") + ". See also the Civil Code,\npart 2, section 12.") == {}


def test_every_frequent_form_of_a_skeleton_is_tried(spark):
    """The fifth most frequent form of one skeleton has misreadings too, and a misread lead stands for its word."""
    forms = {"hand": 900, "bond": 800, "band": 700, "haud": 600, "hond": 500, "b0nd": 2, "hancl": 9, "h0nd": 1}
    got = {r.reading: r.word for r in scan_noise.misreadings(spark.createDataFrame(list(forms.items()), "word string, n bigint"), spark.createDataFrame([], "text string")).collect()}
    assert set(got) >= {"b0nd", "h0nd", "hancl"} and got["hancl"] == "hand"


def test_neighbours_tell_which_word_is_meant(spark):
    texts = ["the clerk has lost the file on it"] * 40 + ["the last day of court"] * 90 + ["he has 1ost the file", "she has 1ost the seal"] + ["on the 1ast day"]
    df = spark.createDataFrame([(f"p{i:03}", t, None, None, None) for i, t in enumerate(texts)], "provision_id string, text string, heading_path string, doc_title string, nation string")
    got = {r.provision_id: r.repaired for r in scan_noise.read(df).collect()}
    assert got == {"p130": "he has lost the file", "p131": "she has lost the seal", "p132": "on the last day"}


def test_reflow_joins_lines(spark):
    df = spark.createDataFrame([("p", "One line\ngoes on.\n\n(a) First\nitem\n(b) second")], "provision_id string, repaired string")
    assert [r.text for r in scan_noise.reflow(df).orderBy("paragraph").collect()] == ["One line goes on.", "(a) First item", "(b) second"]


def test_confusions():
    assert scan_noise.follows("court", "c0urt") and scan_noise.follows("return", "retum") and scan_noise.follows("duty", "cluty")
    assert not scan_noise.follows("court", "count") and not scan_noise.follows("court", "court")
    assert set(scan_noise.skeletons("public")) & set(scan_noise.skeletons("pubhc"))


# Problem 5 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    ["The {{ judge_name }} shall act.", "Paid to ${payee} today", "See <<NAME>> there", "within [insert number] days", "by [County TBD] order", "the [NAME OF JUDGE] acts", "signed ________ here", "on XX/XX/20__ at noon", "must pay XX dollars now",
     "Lorem ipsum dolor", "test test foo bar blah abc", "asdf fdsa sdfa dsaf asdfdsa fdsaf", "item text text text", "404 Not Found", "Please enable JavaScript to view this page", "Your session has expired. Please log in again to continue to /doc12/page9",
     "The court sits. Scripts are disabled, so the remainder of court.example page 3 is hidden."],
)
def test_residue_is_found(text):
    assert residue.Detector()(text)


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n ", "Section 404. [Reserved] The clerk keeps the number.", "Browser records and cookies seized from a person are listed.", "A request that has timed out under section 1-07 may be tried again.", "[Amended, Ord. 57-8-66] The clerk reads it.",
     "If a page of the petition was not found in the record, the clerk reports.", "The blank on the form is to be filled in by the applicant.", "The fine is $500 or $404.", "Fill it in: ```the {{name}} goes here``` and no more of it, said the clerk of the court to the people who came.",
     "The placeholder {{name}} is replaced by the name of the party when the clerk of the court prints the form for the people who asked for it at the window of the office in the village, every day of the week but for the days on which the office is closed."],
)
def test_real_text_is_kept(text):
    assert residue.Detector()(text) == []


@pytest.mark.parametrize(
    "text",
    ["Your\nbrowser must be updated", "too many\nrequests", "(amount to be\nsupplied)", "404 Error", "500 Error", "complete the check", "This is filler text", "Scripts must be enabled", "[ ???]", "[tba by clerk]",
     " ".join(f"clerk{i} reads paper{i}" for i in range(40)) + " pre-test test\nTest. " + " ".join(f"judge{i} rules" for i in range(40)), "foo, bar, baz; item", "Blah x1 x2 x3 x4 x5 x6 qux dummy todo"],
)
def test_filter_lets_residue_through(text):
    assert residue.Detector()(text)


@pytest.mark.parametrize("text", ["[Insert name of tribe]", "[insert\nname]", "[Tribe Name]", "[  Case Number ]", "[\nNAME of party]"])
def test_blanks_in_brackets_whatever_the_case(text):
    assert residue.Detector()(f"The {text} court keeps the record of every hearing and the clerk must mail a copy of it to each party in the case.") == ["placeholder"]


# Pages that no phrase of the grammars was written for: structure must tell them.
UNSEEN = (
    "410 Gone. The resource is no longer available at https://records.village.example/a.", "The website encountered an unexpected error. Please try again later.",
    "An error occurred while processing your request. The server was unable to complete it. Please contact the webmaster.", "Unable to connect to the database. Please contact the support desk.",
    "The proxy failed to reach the upstream. Incident id 77af31c9.", "The cache is damaged. Clear your browser data and press reload.",
)
ENACTED = (
    "Whoever disables the scripts or the server of the council commits an offence and owes $7,500. Copies of the order go to the clerk even if the other side fails to appear.",
    "Power to review a sealed writ is vested in the process server to correct a clerical error. Section 404. The clerk keeps the number.", "Every notice posted on the web site must name the court. Where the server is unavailable, the time is extended.",
    "Cookies and browser history seized under a warrant are listed. Data that cannot be read is marked as damaged.", "The clerk keeps the database of bonds. A record that was damaged is replaced. Contact the clerk for a copy of it.",
)


def test_structure_tells_notices_from_enacted_text():
    d = residue.Detector()
    assert [t for t in UNSEEN if not residue._structure(t) or d(t) != ["error_page"]] == []
    assert [t for t in ENACTED if d(t)] == []


def test_filter_is_a_superset_of_its_grammars():
    from re import _constants as C
    from re import _parser as P

    r, glyphs = random.Random(4), [chr(c) for c in range(32, 127)] + list("–—•●◦·«»")

    def say(seq):
        out = ""
        for op, v in seq:
            if op is C.LITERAL:
                out += chr(v)
            elif op in (C.IN, C.ANY, C.NOT_LITERAL):
                ok = [c for c in "aXb0_ -.[]{}<>/\\?|:(–!" if op is C.ANY or re.fullmatch(one(op, v), c)] if op is not C.IN else [c for c in glyphs if any(k is C.LITERAL and x == ord(c) or k is C.RANGE and x[0] <= ord(c) <= x[1] or k is C.CATEGORY and {C.CATEGORY_SPACE: c.isspace(), C.CATEGORY_DIGIT: c.isdigit(), C.CATEGORY_WORD: c == "a", C.CATEGORY_NOT_SPACE: c == "q"}.get(x, False) for k, x in v)]
                negated = op is C.IN and v[0][0] is C.NEGATE
                out += "a" if negated else r.choice(ok)
            elif op is C.BRANCH:
                out += say(r.choice(v[1]))
            elif op is C.SUBPATTERN:
                out += say(v[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                for _ in range(r.randint(v[0], min(v[0] + 2, int(v[1])))):
                    out += say(v[2])
        return out

    def one(op, v):
        return f"[^{re.escape(chr(v))}]"

    for grammars in (*residue._GRAMMARS.values(), (residue._STRUCTURE["technique"],)):
        for g in grammars:
            need = residue.required(g)
            assert need, g
            for _ in range(60):
                low = " ".join(say(P.parse(g, re.I)).split()).lower()
                assert any(t in low for t in need), (g, low)


def test_residue_of_tables(spark):
    df = spark.createDataFrame([("a", "Lorem ipsum"), ("a", "Lorem ipsum"), (None, "Lorem ipsum"), ("b", None), ("c", " ".join(f"clerk {i} files an order" for i in range(20000)))], "provision_id string, text string").withColumn("residue", residue.F.lit(1))
    assert [r.provision_id for r in residue.detect(df).collect()] == ["a", "a"]
    assert residue.detect(df.limit(0)).count() == 0
    assert {r.provision_id for r in residue.exclude(df.where("provision_id is not null")).collect()} == {"b", "c"}


# Problem 6 -----------------------------------------------------------------------------------------------------

DOCS = "doc_id string, nation string, compiler string, url string, reprint_of string"


def test_related_documents(spark):
    rows = [("d1", "Orrisk", "Ann B. Cole", "http://www.A.example/x/", None), ("d2", "orrisk ", "cole,  ann b", "https://b.example/1", None), ("d3", "Other", "Ann B. Cole", "https://a.example/x#top", None), ("d4", "Other", "unknown", "u4", " D2 "),
            ("d5", "Other", "Unknown", "u5", "d5"), ("d6", "Other", None, "u6", "gone"), ("d6", "Other", None, "u6", "gone"), (None, "Other", "Ann B. Cole", "u7", None), ("d8", None, "", "", None)]
    got = {r.doc_id: r.group_id for r in related_splits.groups(spark.createDataFrame(rows, DOCS).withColumn("k", related_splits.F.lit(1))).collect()}
    assert got == {"d1": "d1", "d2": "d1", "d3": "d1", "d4": "d1"}
    assert related_splits.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_spanning_forest_has_no_circle(spark):
    r = random.Random(2)
    e = spark.createDataFrame([(*sorted((f"v{r.randrange(40):02}", f"v{r.randrange(40):02}")), "x") for _ in range(120)], "a string, b string, why string").where("a <> b").distinct()
    forest = related_splits.spanning_forest(e)
    comp = related_splits.roots(forest)
    n, k = comp.count(), comp.select("comp").distinct().count()
    assert related_splits.trees(forest).count() == n - k == n - len({find for find in grouping_of(e.collect()).values()})


def grouping_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in edges:
        x, y = sorted((find(r.a), find(r.b)))
        parent[y] = x
    return {v: find(v) for v in parent}


def test_groups_stay_in_one_split(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "N", f"C {i // 2}", f"u{i}", None) for i in range(200)], DOCS)
    prov = spark.createDataFrame([(f"d{i:03}-{j}", f"d{i:03}") for i in range(200) for j in range(1 + i % 7)], "provision_id string, doc_id string")
    got = related_splits.deal(docs, prov).toPandas()
    assert (got.groupby("group_id")["split"].nunique() == 1).all() and len(got) == 200
    share = got.groupby("split")["n_provisions"].sum() / got["n_provisions"].sum()
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01 and abs(share["validation"] - 0.1) < 0.01


def test_splits_of_very_unequal_groups(spark, monkeypatch):
    monkeypatch.setattr(related_splits, "LISTED", 20)  # small bands are listed, large ones dealt along the running size
    sizes = [180, 90, 60, 41, 40] + [1 + i % 9 for i in range(400)]
    docs = spark.createDataFrame([(f"d{i:03}", "N", None, None, None) for i in range(len(sizes))] + [("none", "N", None, None, None)], DOCS)
    prov = spark.createDataFrame([(f"d{i:03}-{j}", f"d{i:03}") for i, n in enumerate(sizes) for j in range(n)], "provision_id string, doc_id string")
    got = related_splits.deal(docs, prov).toPandas()
    share = got.groupby("split")["n_provisions"].sum() / got["n_provisions"].sum()
    assert max(abs(share["train"] - 0.8), abs(share["test"] - 0.1), abs(share["validation"] - 0.1)) < 0.01 and len(got) == len(sizes) + 1


# Problem 7 -----------------------------------------------------------------------------------------------------


def test_pairs_equal_brute_force(spark):
    texts = some_texts(150, 9) + ["same words again and again " * 8, "same words again and again " * 9, "one two three " * 30]
    texts += [texts[0], texts[0].upper() + "!"]
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts)] + [("k000", texts[0]), ("n1", None), ("n2", " "), (None, texts[0])]
    df = spark.createDataFrame(rows, "provision_id string, text string").withColumn("bucket", neardup.F.lit("x"))
    got = {(r.provision_id_a, r.provision_id_b) for r in neardup.pairs(*neardup.similar(df)).collect()}
    s = {k: phrase_set(t) for k, t in rows if k}
    keys = sorted(k for k in s if s[k])
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert got == want and len(want) > 30


def test_hot_phrases_groups_and_classes_are_split(spark, monkeypatch):
    """A family of near-copies and copies, with every bound so small that all of it is split, equals brute force."""
    monkeypatch.setattr(phrases, "HOT", 4)
    monkeypatch.setattr(neardup, "PIECE", 3)
    monkeypatch.setattr(neardup.expand, "__defaults__", ("key", 3))
    r = random.Random(6)
    base = [r.choice(WORDS) + str(r.randrange(60)) for _ in range(60)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = r.choice(WORDS)
        texts.append(" ".join(w))
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts)]
    got = [(x.provision_id_a, x.provision_id_b) for x in neardup.pairs(*neardup.similar(spark.createDataFrame(rows, "provision_id string, text string"))).collect()]
    s = {k: phrase_set(t) for k, t in rows}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert set(got) == want and len(got) == len(want) > 100


def test_buckets_fill_partitions_evenly(spark):
    names = phrases.even_names(spark, 7)
    df = spark.createDataFrame([(int(x),) for x in names.ravel()], "bucket int").repartition(7, "bucket").select("bucket", phrases.F.spark_partition_id().alias("p"))
    at = {r.bucket: r.p for r in df.collect()}
    assert [at[int(a)] == at[int(b)] == i for i, (a, b) in enumerate(names)] == [True] * 7


def test_lookups_go_before_groups_are_opened(spark, monkeypatch):
    folder, opened, write = lineage.shared_dir(spark).removeprefix("file://"), neardup.open_groups, neardup.materialise
    tables, held, tidied = set(os.listdir(folder)) if os.path.isdir(folder) else set(), [], []

    def spied(*args):
        held.append(sorted(x.partition("-")[0] for x in set(os.listdir(folder)) - tables))
        return opened(*args)

    def written(df, name="step", tidy=False):
        tidied.append(tidy)
        return write(df, name, tidy)

    monkeypatch.setattr(neardup, "open_groups", spied)
    monkeypatch.setattr(neardup, "materialise", written)
    rows = [(f"k{i:03d}", t) for i, t in enumerate(some_texts(60, 4))]
    neardup.similar(spark.createDataFrame(rows, "provision_id string, text string"))
    assert held == [["classes", "members", "wanted"]] and len(tidied) == 6 and all(tidied)  # shuffle files go with each write


def test_pairs_of_nothing(spark):
    links, members = neardup.similar(spark.createDataFrame([("a", "too short")], "provision_id string, text string"))
    assert neardup.pairs(links, members).count() == 0


def test_phrases_are_told_apart():
    g, doc, n = phrases.phrases(["A b c d e f " * 6, None, "x\0y", "A B C D E F " * 6])
    assert list(n) == [36, 0, 2, 36] and list(g[doc == 0]) == list(g[doc == 3])
    assert len(set(g)) == 6  # the runs of five of a circle of six words


# Problem 8 -----------------------------------------------------------------------------------------------------


def test_ids_and_round_trip(spark):
    import tiktoken

    pieces = tokenizer.read_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=tokenizer.PRE_TOKEN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    texts = [None, "", "  ", " a\n\n b\t", "<|endoftext|> naïve — ‘quoted’ 日本語 🙂", "x" * 3000, "a  b   c\r\n d's we'll", "zero​width space \x1c ok", "word " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode(df).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode(df.limit(0)).count() == 0


# Problem 9 -----------------------------------------------------------------------------------------------------


def test_mixtures(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2] if i < 380 else "c", "word " * (1 + i % 9)) for i in range(400)] + [(900, "a", None), (901, None, "word word"), (902, "a", "")], "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("m", "a", 0.5, 2, 1.0), ("m", "b", 0.3, 1, 1.0), ("m", "c", 0.2, 2, 1.0), ("m", "gone", 0.1, 5, 1.0), ("m", "a", 0.5, 2, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    mixture, report = mixing.mix(docs.withColumn("shard", mixing.F.lit(1)), goals, shards=5)
    r = {x.source: x for x in report.collect()}
    assert {k: x.short for k, x in r.items()} == {"a": False, "b": False, "c": True, "gone": True}
    assert abs(r["a"].actual - r["a"].wanted) <= 10 and r["c"].actual == 2 * r["c"].source_tokens
    m = mixture.toPandas()
    assert not m.duplicated(["mix_id", "doc_id", "repeat"]).any() and m.groupby(["source", "doc_id"]).size().max() <= 2
    assert (m.groupby("shard")["place"].max() == m.groupby("shard").size()).all()


def test_quotas_are_exact():
    q = np.array([7, 0, 3, 20])
    s = mixing.split_quotas(q, 6, np.random.default_rng(1))
    assert (s.sum(0) == q).all() and s.shape == (6, 4) and s.sum(1).max() - s.sum(1).min() <= 2


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("m", "a", 0.5, 2, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    mixture, report = mixing.mix(docs, goals)
    assert mixture.count() == 0 and [(x.actual, x.short) for x in report.collect()] == [(0, False)]


# Problem 10 ----------------------------------------------------------------------------------------------------


def test_subjects_held_out(spark):
    r = random.Random(4)
    topics = {"water": ["river", "pump", "well", "flood"], "school": ["pupil", "essay", "teacher", "grade"], "sport": ["goal", "team", "match", "referee"], "land": ["parcel", "deed", "fence", "tenant"], "health": ["nurse", "clinic", "vaccine", "ward"], "tax": ["levy", "budget", "audit", "refund"]}
    plain = ["the meeting opened at noon", "the next review is due", "all present agreed on it"]

    def doc(names):
        out = []
        for _ in range(12):
            k = r.choice([*names, None])
            out.append(r.choice(plain) if k is None else f"the {r.choice(topics[k])} near the {r.choice(topics[k])} was seen by members")
        return ". ".join(out) + "."

    truth = {i: r.sample(sorted(topics), 1 + i % 2) for i in range(260)}
    docs = spark.createDataFrame([(i, doc(t)) for i, t in truth.items()] + [(900, None), (901, ""), (902, "the meeting opened at noon. the next review is due."), (903, "x" * 100000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s.upper() + " ", "c") for i, t in truth.items() if i < 180 for s in t] + [(None, "water", "c"), (1, None, "c"), (2, "nothing", "c")], "doc_id bigint, subject string, share string")
    names = spark.createDataFrame([(k,) for k in topics], "subject string")
    got = {(x.doc_id, x.subject) for x in subjects.deal_with(docs, labels, names).collect()}
    want = {(i, s) for i, t in truth.items() for s in t}
    held = {x for x in want if x[0] >= 180}
    right = {x for x in got if x[0] >= 180} & held
    assert len(right) > 0.9 * len(held) and len({x for x in got if x[0] >= 180} - held) < 0.1 * len(held)
    assert not {x for x in got if x[0] >= 900}


def test_long_words_keep_their_features():
    one, two = b"clinic" * 30, b"harbour" * 30
    a, b = subjects.features(one), subjects.features(two)
    assert len(a) == 1 + (len(one)) + (len(one) - 1) and set(a[1:]) != set(b[1:]) and a[0] != b[0]


def test_subjects_without_labels(spark):
    docs = spark.createDataFrame([(1, "the river")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.deal_with(docs, none, spark.createDataFrame([("water",)], "subject string")).count() == 0


def test_catalogue_names_all_problems():
    from tesselith.llm import catalogue

    names = set(catalogue.queries())
    assert all(f"p{n}_found" in names for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)) and "p8_ids" in names
    assert set(catalogue.oracle_sql()) <= names
    assert pd.__name__ == "pandas"
