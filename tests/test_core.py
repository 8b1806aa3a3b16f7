"""Functions on hand-written rows, properties of the operators, sources and streams."""

import itertools
import json
import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import annotation, diffusion, linear, measures, models, passages, pools, ranks, related, resample, segments, splits
from tesselith.plans import q_models
from tesselith.sources import pages, records
from tesselith.streaming import arrivals


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,heading,label,support",
    [("As used in this part, a bond is money.", "", "DEFINITION", 1), ("The court shall have power and jurisdiction over it.", "", "GRANT_OF_AUTHORITY", 1), ("He is guilty and shall be fined.", "", "SANCTION_REMEDY", 1),
     ("A party is entitled to a copy.", "", "RIGHT_ENTITLEMENT", 1), ("It is unlawful to enter.", "", "PROHIBITION", 1), ("The clerk must act.", "", "OBLIGATION", 1), ("Upon motion of a party the day is set.", "", "PROCEDURE", 1),
     ("This chapter shall apply to all.", "", "SCOPE_APPLICABILITY", 1), ("Nothing fires here.", "", None, 0), (None, None, None, 0), ("Words.", "Definitions", "DEFINITION", 1), ("Words.", "Purpose and scope", "SCOPE_APPLICABILITY", 1),
     ("No person shall enter; the clerk must act.", "", "PROHIBITION", 2)],
)
def test_cascade(spark, text, heading, label, support):
    got = one(spark, T.rule_label(F.col("t"), F.col("h")), t=text, h=heading)
    assert (got.label, got.support) == (label, support)


@pytest.mark.parametrize("text,want", [("No person shall enter.", ["MUST_NOT"]), ("Bond shall mean money.", ["NONE"]), ("He may ask and the clerk shall act.", ["MAY", "MUST"]), ("", ["NONE"]), (None, ["NONE"])])
def test_modality(spark, text, want):
    assert one(spark, T.modality(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("25 U.S.C. 1301", ["FEDERAL"]), ("the State of Utah", ["STATE"]), ("by custom of the elders", ["CUSTOM"]), ("under section 12", ["INTERNAL"]), ("none", []), (None, [])])
def test_references(spark, text, want):
    assert one(spark, T.references(F.col("t")), t=text) == want


def test_masks(spark):
    t = "The fee in Section 4-01 is $1,200.50 for Ann Cole under 25 U.S.C. § 1301 within 30 days. The Court agrees."
    assert one(spark, T.mask(F.col("t"), 2), t=t) == "The fee in §SEC is §AMT for §NAME §NAME under §CITE within §NUM days. The Court agrees."
    assert one(spark, T.mask(F.col("t"), 3, ["fee", "court agrees"]), t=t).startswith("The §CUE in §SEC") and one(spark, T.mask(F.col("t"), 1), t=None) is None


def test_small_functions(spark):
    assert one(spark, T.host(F.col("u")), u="HTTPS://www.Court.example/a?b") == "court.example" and one(spark, T.host(F.col("u")), u=None) == ""
    assert one(spark, T.structural_domain(F.col("a")), a="Title 1 Civil Rights > Criminal Code") == "criminal" and one(spark, T.structural_domain(F.col("a")), a="Civil Code and Crimes") is None
    assert one(spark, T.n_words(F.col("a")), a="  a \n b ") == 2 and one(spark, T.n_words(F.col("a")), a=None) == 0
    assert one(spark, T.group_name(F.col("a")), a="Sac Band (east) of the Long Reservation, Utah") == "Sac Band"
    assert one(spark, T.last_year(F.col("a")), a="in 1949, 1975 and 2031") == 1975 and one(spark, T.last_year(F.col("a")), a=None) is None
    assert one(spark, T.contents_line(F.col("a")), a="Section 4. Short title ..... 12") and not one(spark, T.contents_line(F.col("a")), a="The clerk acts.")
    assert one(spark, T.normal_form(F.col("a")), a="ﬁne­ness  x") == "fineness x"
    assert one(spark, F.size(T.shingles(F.col("a"))), a="too short") == 1 and one(spark, F.size(T.shingles(F.col("a"), 9, "[a-z]+")), a="too short") == 0 and one(spark, F.size(T.shingles(F.col("a"))), a=None) == 1
    got = one(spark, T.reply_lines(F.col("a")), a="[1] DEFINITION\nnoise\n [2] PROCEDURE ")
    assert [(r.n, r.label) for r in got] == [(1, "DEFINITION"), (2, "PROCEDURE")]


def test_heading_stack_resets(spark):
    rows = [("d", 0, 0, "Title 1"), ("d", 10, 1, "Chapter 1"), ("d", 20, None, None), ("d", 30, 0, "Title 2"), ("d", 40, None, None), ("e", 5, None, None)]
    got = passages.heading_stack(spark.createDataFrame(rows, "doc string, pos int, level int, label string"), "doc", "pos", "level", "label")
    assert {(r.doc, r.pos): (r.path, r.deepest) for r in got.where("level is null").collect()} == {("d", 20): ("Title 1 > Chapter 1", "Chapter 1"), ("d", 40): ("Title 2", "Title 2"), ("e", 5): ("", "")}


@pytest.mark.parametrize("n,dropped", [(3, 0), (4, 4)])
def test_islands(spark, n, dropped):
    lines = [("d", i, i < n, False) for i in range(n)] + [("d", n, False, False)]
    got = passages.islands(spark.createDataFrame(lines, "doc string, pos int, flag boolean, blank boolean"), "doc", "pos", "flag", "blank", 4)
    assert got.where("drop").count() == dropped


def test_first_wins_and_walk(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in passages.first_wins(df, ["k"], ["o"]).collect()} == {("a", "y"), (None, "z")}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.node: r.depth for r in related.walk(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_shared_pairs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [("1", "g", base), ("2", "h", base), ("3", "g", base + " fourteen"), ("4", "h", "short text"), ("5", "i", None)]
    df = spark.createDataFrame(rows, "id string, grp string, t string").withColumn("s", T.shingles(F.col("t")))
    got = {(r.a, r.b): round(r.j, 3) for r in diffusion.shared_pairs(df, "id", "grp", "s").collect()}
    assert got == {("1", "2"): 1.0, ("2", "3"): 0.833}
    many = spark.createDataFrame([(f"{i:03}", f"g{i}", base) for i in range(41)], "id string, grp string, t string").withColumn("s", T.shingles(F.col("t")))
    assert diffusion.shared_pairs(many, "id", "grp", "s").count() == 0  # more than 40 postings


def test_shared_pairs_equal_brute_force_and_store_little(spark, monkeypatch):
    r = random.Random(5)
    texts = [[r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.choice((8, 30, 90, 200)))] for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(r.choice(texts))
        for _ in range(r.choice((0, 0, 1, 3))):
            w[r.randrange(len(w))] = "new" + str(r.randrange(50))
        rows.append((f"r{i:03}", f"g{i % 7}", " ".join(w)))
    df = spark.createDataFrame(rows, "id string, grp string, t string").select("id", "grp", T.shingles(F.col("t"), 3).alias("s"))
    written = []
    keep = diffusion.materialise
    monkeypatch.setattr(diffusion, "materialise", lambda d, name="step", **k: written.append((name, d.columns)) or keep(d, name, **k))
    monkeypatch.setattr(diffusion, "PASS_ROWS", 3000)  # several passes
    got = {(x.a, x.b): (x.grp_a, x.grp_b, round(x.j, 9)) for x in diffusion.shared_pairs(df, "id", "grp", "s", at_least=0.7).collect()}
    sets = {x.id: (x.grp, set(x.s)) for x in df.collect()}
    first = {i: sorted(s)[:60] for i, (_, s) in sets.items()}
    held = Counter(g for s in first.values() for g in s)
    useful = {i: {g for g in s if 2 <= held[g] <= 40} for i, s in first.items()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        (ga, sa), (gb, sb) = sets[a], sets[b]
        if ga != gb and useful[a] & useful[b] and (j := len(sa & sb) / len(sa | sb)) >= 0.7:
            want[a, b] = (ga, gb, round(j, 9))
    assert got == want and len(want) > 50
    assert [n for n, c in written if "s" in c] == ["sets"]  # whole sets of candidates only


def test_near_elsewhere_equals_brute_force_on_hot_shingles_and_copies(spark, monkeypatch):
    r = random.Random(9)
    stock = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(12)) for _ in range(6)]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(f"b{i:03}", f"g{i % 5}", base) for i in range(60)]  # more than 40 hold each shingle
    rows += [(f"c{i:03}", "g1", "a text that stands in one group only and is copied there again") for i in range(50)]
    rows += [(f"n{i}", None, base + f" {i}") for i in range(3)] + [("e1", "g1", ""), ("e2", "g2", ""), ("s1", "g1", "short"), ("s2", "g3", "other"), ("z", "g1", base + " x")]
    for i in range(150):
        w = " ".join(r.sample(stock, 3) + [f"w{r.randrange(40)}" for _ in range(r.choice((0, 1, 9, 30)))]).split()
        rows += [(f"t{i:03}{j}", f"g{r.randrange(4)}", " ".join(w[: len(w) - r.randrange(6)])) for j in range(2)]
    df = spark.createDataFrame(rows, "id string, grp string, words string")
    sets = {x.id: (x.grp, set(x.s)) for x in df.select("id", "grp", T.shingles(F.col("words")).alias("s")).collect()}
    want = {a for (a, (g, s)), (h, o) in itertools.product(sets.items(), sets.values()) if g and h and g != h and len(s & o) / len(s | o) >= 0.7}
    monkeypatch.setattr(diffusion, "PASS_ROWS", 300)  # several passes
    for log in (20, 6):  # cells that many shingles share change nothing
        monkeypatch.setattr(diffusion, "LEAST_CELLS", log)
        monkeypatch.setattr(diffusion, "MOST_CELLS", log)
        hits = diffusion.near_elsewhere(df, "id", "grp", "words", 0.7)
        assert hits.count() == hits.distinct().count()
        got = {x.id for x in df.where("grp is not null").withColumn("text", F.md5("words")).join(hits, "text", "left_semi").collect()}
        assert got == want and {"b000", "z", "e1"} <= got and not got & {"c000", "n0", "s1"} and len(got) < len(rows) - 60


def test_sketches_of_words_equal_those_of_shingles(spark):
    texts = ["", None, " a ", "one two  three four five six seven eight nine", "A b c d e f g h i j k l é\n" * 9, "straße Ünd\t so weiter " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.lit("g").alias("grp"), T.shingles(F.col("t")).alias("s"), T.squash(F.lower(T.blank(F.col("t")))).alias("words"))
    made = []
    for c, k in (("s", None), ("words", 9)):
        table = df.select("id", "grp", c).toArrow()
        made.append([r for b in diffusion._sketches(60, k, table.combine_chunks().to_batches()) for r in b.to_pylist()])
    assert made[0] == made[1] and [r["n"] for r in made[0]][:4] == [1, 1, 1, 1]


def test_measures_with_known_answers(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d2", "b"), ("d2", "b")], "g string, l string")
    assert measures.theil_u(df, "g", "l").first().u == pytest.approx(1.0)
    assert measures.theil_u(df.withColumn("one", F.lit("x")), "one", "l").first().u == pytest.approx(0.0)
    same = measures.confusion(df, "l", "l")
    assert measures.kappa(same).first().kappa == pytest.approx(1.0) and measures.alpha(same).first().alpha == pytest.approx(1.0)
    half = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")], "t string, p string")
    assert measures.kappa(measures.confusion(half, "t", "p")).first().kappa == pytest.approx(0.0)
    d = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 0.0), ("y", "a", 0.0), ("y", "b", 1.0)], "k string, label string, q double")
    got = measures.jsd(d.withColumn("q", F.col("q") + 1e-12), "k").first().jsd
    assert got == pytest.approx(1.0, abs=1e-6)


def test_exact_tests(spark):
    three = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, d double")
    assert resample.sign_flip_exact(three, "g", "d").first().p == pytest.approx(0.25)
    t = spark.createDataFrame([(3, 1, 1, 3)], "a bigint, b bigint, c bigint, d bigint")
    assert resample.fisher(t).first().p == pytest.approx(0.4857142857)
    rows = spark.createDataFrame([("x", "x", "y")] * 5 + [("x", "y", "x")], "t string, a string, b string")
    assert resample.mcnemar(rows, "t", "a", "b").first().p == pytest.approx(14 / 64)


def test_fisher_with_large_counts(spark):
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    a, b, c, d = 60_000, 50_000, 59_500, 50_500
    lp = [lc(a + b, x) + lc(c + d, a + c - x) - lc(a + b + c + d, a + c) for x in range(9_500, 110_001)]
    want = sum(math.exp(x) for x in lp if x <= lp[a - 9_500] + 1e-7)
    t = spark.createDataFrame([(a, b, c, d), (3_000_000_000, 1, 1, 3)], "a bigint, b bigint, c bigint, d bigint")
    began = time.time()
    got = {r.a: r.p for r in resample.fisher(t).collect()}
    assert got[a] == pytest.approx(want, abs=1e-7) and got[3_000_000_000] < 1e-12 and time.time() - began < 60


def _rows(spark, n=200):
    r = random.Random(3)
    return spark.createDataFrame([(f"p{i}", f"g{i % 5}", f"d{i % 23}", r.choice("abc")) for i in range(n)], "id string, grp string, doc string, lab string")


def test_folds_are_whole_and_independent_of_partitions(spark):
    df = _rows(spark).withColumn("doc", F.concat("grp", "doc"))
    got = splits.document_folds(df, "grp", "doc", 4, "s")
    assert got.count() == 200 and got.groupBy("doc").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    a, b = (splits.stratified_folds(x, "lab", "id", 5, "s").select("id", "fold").toPandas().sort_values("id").to_numpy().tolist() for x in (df, df.repartition(7)))
    assert a == b
    every = splits.regimes(df, "grp", "doc", "id", 0.3, "s")
    assert every.select("held").distinct().count() == 5 and every.count() == 5 * 200
    r = splits.regimes(df, "grp", "doc", "id", 0.3, "s", held_out=["g1"]).toPandas()
    assert r.equals(every.where("held = 'g1'").select(*r.columns).toPandas().set_index("id").loc[r["id"]].reset_index()[list(r.columns)])
    test_docs = set(r[r.test].doc)
    assert not (r.test & r.train_random).any() and not set(r[r.train_doc].doc) & test_docs and not (r[r.train_group].grp == "g1").any()
    assert r.train_random.sum() <= r.train_group.sum()


def test_dose_draw_and_ranks(spark):
    df = _rows(spark)
    got = splits.dose_draw(df, "lab", "doc", "id", 3, 6, "s").toPandas()
    assert (got.groupby("lab").size() == 6).all() and (got.groupby("lab")["doc"].nunique() == 3).all()
    assert splits.dose_draw(df, "lab", "doc", "id", 3, 6000, "s").count() == 0
    ranked = ranks.hash_rank(df.withColumn("n", F.lit(None).cast("string")), ["n"], passages.by_hash("z", "id"), "id", "k").toPandas()
    assert sorted(ranked.k) == list(range(1, 201))


def test_planted_signal(spark):
    r = random.Random(1)
    filler = "court clerk order notice bond fine council member hearing record".split()
    rows = []
    for d in range(24):
        tag = f"tag{d}"
        for j in range(8):
            text = " ".join([tag] * 3 + [f"label{d % 2}x" if j >= 0 and d >= 0 else ""] * 0 + r.choices(filler, k=12))
            rows.append((f"{d}-{j}", f"g{d % 2}", f"d{d}", text, text + f" plain{d % 2}"))
    df = spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string, clear string")
    got = {x.split: x.macro_f1 for x in models.probe(df, "grp", "grp", "doc_id", "provision_id").collect()}
    assert got["random"] > 0.95 and got["documents_held_out"] < 0.8  # the label is carried by documents only
    clear = {x.split: x.macro_f1 for x in models.probe(df.drop("text").withColumnRenamed("clear", "text"), "grp", "grp", "doc_id", "provision_id").collect()}
    assert min(clear.values()) > 0.9  # the label is carried by the text everywhere


def test_terms_of_training_rows_are_masked(spark):
    rows = [(f"{g}{i}", g, f"{g}{i % 4}", f"the {g}word clerk number{i % 5} keeps the file of the court") for g in ("ab", "cd") for i in range(24)]
    df = spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string")
    got = {x: models.probe(df, "grp", "grp", "doc_id", "provision_id", 2, level=x).where("split = 'random'").first() for x in (0, 3)}
    assert got[0].macro_f1 == 1.0 and got[3].macro_f1 < 0.7 and got[0].mean_fold_f1 == 1.0 and got[0].unseen == 0
    assert "abword" in models.group_terms(df, "grp", "text") and models.fit_predict(*[models.vectors(df.withColumn("f", F.lit(True)), "f", models.hashed(df, "provision_id", "text"))] * 2, "grp", "provision_id", "svm").where("t = p").count() == 48


def test_matched_and_retried_folds(spark):
    df = _rows(spark).withColumn("doc", F.concat("grp", "doc"))
    docs = splits.document_folds(df, "grp", "doc", 4, "s", "doc_fold")
    got = splits.matched_folds(docs, "lab", "doc_fold", "id", 4, "s").toPandas()
    left = 200 - docs.groupBy("doc_fold").count().toPandas().set_index("doc_fold")["count"]
    assert all(got[f"train_{f}"].sum() == min(left[f], (got.fold != f).sum()) and not (got[f"train_{f}"] & (got.fold == f)).any() for f in range(4))
    few = spark.createDataFrame([(f"{v}{d}-{i}", v, f"{v}{d}") for v in "xy" for d in range(3) for i in range(2)], "id string, lab string, doc string")
    folds, tries = splits.retried_folds(few, "lab", "doc", 2, "s")
    assert splits.unseen(folds, "lab", "fold").count() == 0 and tries < 20 and splits.fold_count(9) == 4
    assert splits.deepest_dose(few, "lab", "doc", 2, values=2)[0] == 3 and splits.deepest_dose(few, "lab", "doc", 3, values=2)[0] == 0


CODE = """TABLE OF CONTENTS
Section 1-01. Court opens
Section 1-02. Clerk keeps
Section 1-03. Judge sits
Section 1-04. Fees due

Text of the code
TITLE 4
Civil Actions
CHAPTER 2 Service
Section 1-01. Court opens
The court shall open at nine on every day of the week but for the days of rest. [History: Ord. 5-1990]
Section 1-02. The clerk must keep the record of every case that comes before the court of the tribe.
It may be read.
TITLE 5 Fees
§ 1-03 - Fees due
A fee is due when the paper has been filed with the clerk of the court in the village.
Rule 9
too short
"""


def test_documents_are_cut_into_passages(spark):
    plain = "Court Opens Early\nThe court shall open at nine on every day of the week but for the days of rest.\nClerk Keeps Records\nThe clerk must keep the record of every case that comes before the court of the tribe.\nNo body here\nshort"
    df = spark.createDataFrame([("d", CODE), ("t", plain), ("n", None), ("e", ""), ("r", CODE.split("TITLE 5")[0].split("CHAPTER 2 Service\n")[1] * 2)], "doc_id string, text string").withColumn("pos", F.lit("x")).withColumn("_k", F.lit(1))
    got = {r.provision_id: r for r in segments.provisions(df, "doc_id").collect()}
    assert set(got) == {"d-0000", "d-0001", "d-0002", "t-0000", "t-0001", "r-0000", "r-0001"}  # repeats in a document count once
    a, b, c = (got[f"d-000{i}"] for i in range(3))
    assert (a.section, a.heading, a.path, a.history) == ("1-01", "Court opens", "Title 4 Civil Actions > Chapter 2 Service", "Ord. 5-1990") and a.text.endswith("days of rest.")
    assert (b.heading, b.text.split("\n")[1]) == ("", "It may be read.\nTITLE 5 Fees".split("\n")[0]) and (c.section, c.heading, c.path) == ("1-03", "Fees due", "Title 5 Fees")
    assert (got["t-0001"].heading, got["t-0001"].unnumbered) == ("Clerk Keeps Records", True) and CODE[a.off :].startswith("Section 1-01")
    assert segments.provisions(df.limit(0), "doc_id").count() == 0


def test_names_are_masked_as_whole_words(spark):
    t = "The Court hears Ann O'Neil-Smith. Smith-Jones asks; Judges of Utah\n  Talvenna agree: Zed's"
    assert one(spark, T.redact_names(F.col("t")), t=t) == "The Court hears §NAME §NAME. Smith-Jones asks; Judges of §NAME\n  Talvenna agree: Zed's"
    assert one(spark, T.group_name(F.col("a")), a="Orrisk Nation of the Deep Reservation") == "Orrisk Nation"


def test_gold_and_replies(spark):
    rows = [(0, "p1", None, "A", "A", "A"), (1, "p2", "B", "B", None, "INSUFFICIENT_CONTEXT"), (2, "p1", None, "A", "A", "B"), (3, "p2", None, None, "C", "C"), (4, "p3", "A", "A", "B", "A")]
    df = spark.createDataFrame(rows, "i int, provision_id string, suggested string, rule string, model string, label string")
    assert {r.provision_id: r.gold for r in annotation.gold(df, "provision_id").collect()} == {"p1": "A", "p2": "C", "p3": "A"}
    assert {(r.provision_id, r.first, r.second, r.blind) for r in annotation.repeats(df, "provision_id").collect()} == {("p1", "A", "B", True), ("p2", "INSUFFICIENT_CONTEXT", "C", False)}
    agree = {r.shown: r for r in annotation.agreement(df, "rule", "model").collect()}
    assert (agree["blind"].n, agree["blind"].rule_n, agree["blind"].rule_rate) == (3, 2, 0.5) and agree["suggested"].accepted == 1.0
    texts = spark.createDataFrame([("a", "Hello\n[1] A\n[2] Z\n[1] B\n\n[3] B"), ("b", None)], "tag string, text string")
    answers, counts = annotation.replies(texts, "tag", "text", ["A", "B"])
    assert {(r.n, r.label) for r in answers.collect()} == {(1, "A"), (3, "B")} and [(r.n_answers, r.n_bad) for r in counts.collect()] == [(2, 3)]
    index = spark.createDataFrame([("a", 1, "A"), ("a", 2, "B")], "tag string, n int, gold string")
    assert {(r.n, r.pred) for r in annotation.answered(index, answers).collect()} == {(1, "A"), (2, None)}
    shot = annotation.zero_shot(spark.createDataFrame([("p", "this text states prohibition"), ("q", None)], "k string, text string"), "k", "text", annotation.HYPOTHESES)
    assert {r.k: r.label for r in shot.collect()}["p"] == "PROHIBITION" and all(abs(sum(r.probs.values()) - 1) < 1e-9 for r in shot.collect())


def test_resampling_with_known_answers(spark):
    same = spark.createDataFrame([(f"g{i}", "a", "a", "b") for i in range(6)], "g string, t string, one string, two string")
    b = resample.paired_bootstrap(same, "g", "t", "one", "two", 20, "s")
    got = resample.paired_interval(b).first()
    assert got.f1_one_low == 1.0 and got.ratio_low is None and got.gap_p == pytest.approx(2 / 21)
    assert resample.row_bootstrap(same, "t", "one", 7, "s").agg(F.min("macro_f1"), F.count("*")).first() == (1.0, 7)
    d = resample.draws(same, "g", 50, "s").groupBy("rep").agg(F.sum("m").alias("m")).toPandas()
    assert len(d) == 50 and (d.m == 6).all()  # as many draws as clusters
    assert resample.draws(same.limit(0), "g", 5, "s").count() == 0
    slopes = spark.createDataFrame([(m, float(m) ** -0.5) for m in (1, 2, 4, 8) for _ in range(3)], "m int, v double")
    s = resample.block_slope(slopes, "m", "v", 50).first()
    assert s.slope == pytest.approx(-0.5) and s.p == pytest.approx(2 / 24) and s.low == pytest.approx(-0.5)
    eq = resample.equivalence(spark.createDataFrame([(f"g{i}", 0.01 * (i % 3 - 1)) for i in range(12)], "g string, d double"), "g", "d", 0.2, 400, "s").first()
    assert eq.equivalent and eq.n == 12
    assert resample.divergence_floor({"a": 5, "b": 5}, 20, 30, "s", spark).where("jsd >= 0 and jsd <= 1").count() == 30
    ranked = measures.average_ranks(spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, None)], "v double"), "v", "r").collect()
    assert sorted((x.v, x.r) for x in ranked if x.v) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]
    u = measures.theil_u_adjusted(spark.createDataFrame([(f"r{i}", f"d{i % 4}", f"l{i % 4}") for i in range(40)], "k string, g string, l string"), "g", "l", "k", 9, "s").first()
    assert u.u == pytest.approx(1.0) and u.adjusted == pytest.approx(1.0) and u.p == pytest.approx(0.1) and u.null < 0.5


def test_pools_and_crawls(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "ab"[i % 2], f"d{i % 6}", f"text {i}", i % 3 == 0) for i in range(12)] + [("n", None, "d", "x", None)], "id string, v string, d string, t string, dup boolean")
    pool = pools.adapted(df, F.col("v"), F.col("d"), F.col("t"))
    assert pool.count() == 12 and pools.quota(pool, 2, "s").select("label", "doc_id").distinct().count() == 4
    assert pools.conditions(df, {"all": F.lit(True), "plain": ~F.col("dup")}).groupBy("condition").count().count() == 2 and pools.without(df, "v", ["a"]).count() == 7
    assert one(spark, pools.first_field(F.col("j"), "$.a", "$.b.c"), j='{"a": " ", "b": {"c": "x"}}') == "x"
    assert one(spark, pools.lexicon_mask(F.col("t"), ["Norvale", "abc"]), t="in norvale abc") == "in §LEX abc" and one(spark, pools.place_mask(F.col("t"), ["Norvale"]), t="Norvale Section 4") == "§PLACE §SEC"
    assert pools.shared_values(df.limit(3), df, "d").first().n == 3 and pools.on_common_keys("id", df.select("id", "v"), df.limit(2).select("id", "t")).count() == 2
    page = spark.createDataFrame([("u", "Intro\nCodes:\nCivil Code\nCourts\nTrial court")], "u string, t string")
    assert {(r.label, r.part) for r in pools.page_slices(page, "u", "t", ["Codes", "Courts"]).collect()} == {("codes", "Civil Code"), ("courts", "Trial court")}
    links = spark.createDataFrame([("http://a.example/", "http://a.example/code/1", "Code"), ("http://a.example/", "http://b.example/code", "Code"), ("http://a.example/", "http://a.example/login", "Code")], "src string, dst string, anchor string")
    assert related.crawl_links(links, "code", "login").count() == 1 and related.crawl_links(links, "code", "login", False).count() == 2
    fetched = spark.createDataFrame([("http://a.example/code.pdf", "Code", "pdf", 9000), ("http://a.example/code2.pdf", "Code", "pdf", 10), ("http://a.example/c", "Code", "html", 3000)], "url string, anchor string, kind string, size int")
    assert related.targets(fetched, "code", 8000, 2500).count() == 2
    anchors = spark.createDataFrame([("p", i, f"/code/{i % 3}", "Code") for i in range(6)], "page string, pos int, href string, anchor string")
    assert [r.pos for r in related.discovered(anchors, "page", "code", 2).orderBy("pos").collect()] == [0, 1]
    records.write_array(df.select("id", "v"), str(tmp_path / "a"))
    assert spark.read.option("multiLine", "true").json(str(tmp_path / "a")).count() == 13
    import lzma

    (tmp_path / "x.xz").write_bytes(lzma.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert records.read_xz_lines(spark, str(tmp_path / "x.xz"), "a int").agg(F.sum("a")).first()[0] == 3
    sheet = spark.createDataFrame([(1, "A"), (2, None)], "i int, label string")
    records.write_sheet(sheet, str(tmp_path / "s"), ["A"])
    assert records.read_coded(spark, str(tmp_path / "s" / "sheet"), ["A"]).count() == 2
    (tmp_path / "old1.json").write_text('[{"i": 1, "label": "B"}]')
    assert {r.i: r.label for r in records.prior_labels(spark, str(tmp_path / "old*.json"), sheet.select("i")).collect()} == {1: "B", 2: None}
    for _ in range(2):
        records.save_point(sheet, str(tmp_path / "points"), m=2)
    assert spark.read.parquet(str(tmp_path / "points")).count() == 2
    assert one(spark, pages.probe_score(F.col("h")), h="<p>civil complaint and bail</p>") == 3 and one(spark, pages.probe_score(F.col("h")), h="Just a moment... bail") == 0


def test_records(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text(json.dumps({"provision_id": "1", "text": "x"}) + "\nbroken\n" + json.dumps({"provision_id": "2", "xnation_dup": True}) + "\n")
    assert records.read_lines(spark, path).count() == 2 and records.read_lines(spark, path, drop_near_dups=True).count() == 1
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "k string, v string")
    assert records.append_new(df, out, "k") == 2 and records.append_new(df, out, "k") == 0 and spark.read.parquet(out).count() == 2
    (tmp_path / "m.json").write_text(json.dumps([{"seed": "s", "pages_fetched": 2, "docs": [{"url": "u1"}, {"url": "u2"}]}]))
    assert records.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "c.csv").write_text("i,label\n1,A\n2,B\n")
    assert records.read_coded(spark, str(tmp_path / "c.csv"), ["A", "B"]).count() == 2
    with pytest.raises(Exception, match="unknown label"):
        records.read_coded(spark, str(tmp_path / "c.csv"), ["A"]).collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "t1.txt").write_text("[1] A")
    assert records.read_replies(spark, str(tmp_path / "r")).first().tag == "t1"
    assert records.resolve(spark, str(tmp_path / "none"), path) == path


def test_pages(spark):
    html = "<nav>Menu</nav><h3>Codes</h3><p>See <a class=x href='/a#top'>First <b>code</b></a></p><script>x()</script><h3>More</h3><a href=\"http://b.example/2\">Second</a><p>Unclosed"
    df = spark.createDataFrame([("http://a.example/i", html), ("n", None)], "url string, html string")
    assert [(r.href, r.anchor) for r in pages.anchors(df).orderBy("pos").collect()] == [("/a#top", "First code"), ("http://b.example/2", "Second")]
    assert [(r.section, r.href) for r in pages.sectioned(df).orderBy("part").collect()] == [("Codes", "/a#top"), ("More", "http://b.example/2")]
    got = [r.t for r in df.select(pages.main_text("html").alias("t")).collect()]
    assert got[0] == "Codes\nSee First code\nMore\nSecond\nUnclosed" and got[1] is None
    assert one(spark, pages.absolute(F.col("b"), F.col("h")), b="http://a.example/i", h="/a#top") == "http://a.example/a"
    links = spark.createDataFrame([("http://a.example/x",), ("http://a.example/private/x",), ("http://c.example/",)], "href string")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private/")], "host string, robots_txt string")
    assert pages.allowed(links, robots, "bot").count() == 2
    assert pages.live(links, robots).count() == 1
    stored = spark.createDataFrame([("http://a.example/x",)], "url string").select(T.url_key(F.col("url")).alias("key"))
    assert pages.fetch_missing(links.withColumnRenamed("href", "url"), stored, lambda u: (200, "ok"), 0).count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00"), (2, "a", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "event_id int, event_type string, t string").select("event_id", "event_type", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    assert arrivals.drain(arrivals.first_arrivals(stream, ["event_id"], "ts", "1 day")).count() == 2


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    whole = set(e.queries())
    monkeypatch.setattr(e, "_llm", lambda: None)
    core = set(e.queries())
    assert core and core <= whole and not any(n[0] == "p" and n[1].isdigit() for n in core)
    assert set(e.oracle_sql()) <= core


def test_a_broken_subpackage_is_an_error(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert e._llm() is None
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: object())
    monkeypatch.setattr(e.importlib, "import_module", lambda name: (_ for _ in ()).throw(ImportError("no regex")))
    with pytest.raises(ImportError):
        e._llm()


def test_scope_deletes_its_tables(spark):
    from tesselith.plans import lineage

    with lineage.scope(spark):
        kept = lineage.materialise(spark.range(3))
        assert kept.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(kept._tesselith_path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_sign_flip_over_all_groups(spark):
    r = random.Random(7)
    few = spark.createDataFrame([(f"g{i}", r.choice([0.25, -0.5, 1.0, r.random()])) for i in range(9)] + [("n", None)], "g string, d double")
    assert [tuple(x) for x in resample.sign_flip_halves(few, "g", "d").collect()] == [pytest.approx(tuple(x)) for x in resample.sign_flip_exact(few, "g", "d").collect()]
    many = spark.createDataFrame([(f"g{i:02}", 1.0) for i in range(24)], "g string, d double")
    assert [tuple(x) for x in resample.sign_flip_halves(many, "g", "d").collect()] == [(24, 1.0, 2, 2 / 2**24)]
    assert resample.sign_flip_halves(many.limit(0), "g", "d").first().n == 0


def _marked(spark, groups=3, n=60):
    r = random.Random(3)
    filler = "court clerk order notice bond fine council member hearing record appeal judge".split()
    rows = [(f"{g}-{i}", f"g{g}", f"g{g}d{i % 6}", " ".join(r.choices(filler, k=10) + [f"sign{g if r.random() < 0.8 else r.randrange(groups)}"])) for g in range(groups) for i in range(n)]
    return spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string")


def test_probe_fits_all_models_in_shared_passes(spark):
    df = _marked(spark)
    first = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    assert min(x.macro_f1 for x in models.probe(df, "grp", "grp", "doc_id", "provision_id").collect()) > 0.6
    spark.range(1).count()
    assert max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - first < 200  # eight fits one by one take several hundred jobs


def test_documents_of_a_group_are_told_in_one_task(spark):
    rows = [(f"{g}{d}{i}", g, f"{g}{d}", f"the clerk of hall{d} keeps file{i % 4} for the court", i % 5) for g in ("a'b", "c|d") for d in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string, fold int")
    got = linear.within(df, "grp", "doc_id", "fold", 5, "provision_id", "text", 4.0, 15, models.FEATURES)
    assert got.count() == 120 and got.where("t = p").count() == 120 and got.select("grp").distinct().count() == 2


def test_a_task_opens_its_training_rows_once_where_they_fit(spark, monkeypatch):
    rows = [(f"{d}{i}", "g", f"d{d}", f"the clerk of hall{d} keeps file{i % 4} for the court", i % 5) for d in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string, fold int")
    sizes, original, fitted = [], linear.Rows, []

    def counting(ptr, *rest):
        sizes.append(len(ptr) - 1)
        return original(ptr, *rest)

    def here(self, f, schema):  # the task's own function, where it can be watched
        fitted.append(f)
        return applied(self, f, schema)

    applied = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", here)
    linear.within(df, "grp", "doc_id", "fold", 5, "provision_id", "text", 4.0, 15, models.FEATURES)
    task = df.withColumn("c", linear.codes("text", models.FEATURES)).selectExpr("grp g", "provision_id key", "doc_id label", "fold", "c", "0 f").toArrow()
    monkeypatch.setattr(linear, "Rows", counting)
    monkeypatch.setattr(linear, "BLOCK", 16)
    got = []
    for room in (1 << 25, 700, 0):
        monkeypatch.setattr(linear, "KEPT", room)
        sizes.clear()
        got.append((fitted[0](task).sort_by("key").to_pydict(), len(sizes)))
    assert got[0][0] == got[1][0] == got[2][0] and got[0][0]["t"] == got[0][0]["p"] and len(got[0][0]["key"]) == 12
    assert got[0][1] == 3 + 3 + 1 < got[1][1] < got[2][1]  # blocks counted, trained and told; no training pass opens a test row


def test_documents_are_told_without_writing_their_texts(spark, monkeypatch):
    written, original = {}, linear.materialise
    for where in (q_models, linear):
        monkeypatch.setattr(where, "materialise", lambda df, name="step", tidy=False: written.update({name: (set(df.columns), tidy)}) or original(df, name, tidy))
    q_models.doc_probe(spark, "/root/testdata/sf0.001")
    assert written and not any("text" in columns or not tidy for columns, tidy in written.values())


def test_parts_may_have_labels_and_models_of_their_own(spark):
    df = _marked(spark).withColumn("other", F.concat(F.lit("o"), F.col("doc_id").substr(-1, 1))).withColumn("fold", F.pmod(F.xxhash64("provision_id"), F.lit(2)))
    got = models.evaluate(df, {"g": ("fold <> 0", "fold = 0"), "o": ("fold <> 0", "fold = 0", "other")}, "grp", "provision_id", ("logistic", "svm"))
    right = {(r.part, r.model): r.x for r in got.groupBy("part", "model").agg(F.avg((F.col("t") == F.col("p")).cast("int")).alias("x")).collect()}
    assert min(right["g", "logistic"], right["g", "svm"]) > 0.7 and max(right["o", "logistic"], right["o", "svm"]) < 0.5
    v = models.vectors(df.withColumn("fit", F.col("fold") != 0), "fit", models.hashed(df, "provision_id", "text"))
    one = models.fit_predict(v.where("fit"), v.where("not fit"), "grp", "provision_id").withColumnRenamed("p", "q")
    both = got.where("part = 'g' and model = 'logistic'").join(one, "provision_id")
    assert both.count() == df.where("fold = 0").count() and both.where("p <> q").count() <= 2  # the same model as Spark ML's, fitted alone


def test_partial_sums_are_added_by_executors(spark, monkeypatch):
    df = _marked(spark, 2, 24).withColumn("fold", F.pmod(F.xxhash64("provision_id"), F.lit(2)))
    got = []
    for most in (16, 0):
        monkeypatch.setattr(linear, "DIRECT", most)
        rows = models.evaluate(df, {"g": ("fold <> 0", "fold = 0")}, "grp", "provision_id", iterations=4)
        got.append({(r.provision_id, r.p) for r in rows.collect()})
    assert got[0] == got[1] and got[0]


def test_products_with_counts_equal_dense_ones():
    r = np.random.default_rng(5)
    x = np.where(r.random((300, 900)) < r.random(900) ** 3, r.integers(1, 400, (300, 900)), 0)
    x[7] = x[299] = x[:, 11] = 0
    ptr, idx = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]).astype(np.int32), np.nonzero(x)[1].astype(np.int32)
    assert (linear.unpacked(ptr, *linear.packed(ptr, idx)) == idx).all() and len(linear.packed(ptr, idx)[0]) == len(idx)
    rows = linear.Rows(ptr, idx, x[x > 0], np.argsort(np.argsort(-(x > 0).sum(axis=0), kind="stable")).astype(np.int32))
    full = np.zeros((300, 900))
    full[:, np.argsort(np.argsort(-(x > 0).sum(axis=0), kind="stable"))] = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0)
    for wide in (1, 7):
        v, w, into = r.normal(size=(900, wide)).astype(np.float32), r.normal(size=(300, wide)).astype(np.float32), np.zeros((900, wide), np.float32)
        rows.back(w, into)
        assert np.abs(rows.times(v) - full @ v).max() < 2e-2 and np.abs(rows.times(v, True) - full**2 @ v).max() < 5e-2 and np.abs(into - full.T @ w).max() < 2e-2
    assert rows.dense.shape[1] < 900 and rows.by_row.at.nbytes < 8 * 2 * len(idx) + 8 * 16 * 300  # lists hold what is there


def test_probes_move_texts_once(spark):
    narrow = q_models._narrow(spark, "/root/testdata/sf0.001", "silver")
    assert "text" not in narrow.columns and narrow.count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q_models._read(spark, "/root/testdata/sf0.001").join(narrow, "provision_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange" in line and "hashpartitioning(provision_id" in line for line in plan.splitlines()) == 2  # one for each side


def test_a_model_of_many_classes_holds_no_wide_blocks(spark):
    ptr, idx = np.arange(0, 3 * 4096 + 1, 3), np.tile(np.arange(3), 4096)
    rows = linear.Rows(ptr, idx, np.ones(len(idx), np.uint8), np.arange(5000, dtype=np.int32))
    assert rows.dense.nbytes <= 4096 * 512 * 4  # the rest are lists


def test_ladder_sets_do_not_depend_on_how_many_are_dealt_at_once(spark):
    rows = q_models._narrow(spark, "/root/testdata/sf0.001")
    groups = sorted(r.grp for r in rows.select("grp").where("grp is not null").distinct().collect())[:4]
    got = [{(r[0], *(tuple(sorted(x)) for x in r[1:])) for r in q_models._sets(rows, groups, n).collect()} for n in (3, 4)]
    assert got[0] == got[1] and len(got[0]) == rows.count()
    one = splits.regimes(rows.select("provision_id", "grp", "doc_id"), "grp", "doc_id", "provision_id", 0.3, "ladder").where(F.col("held") == groups[3])
    assert {r.provision_id for r in one.where("train_doc").collect()} == {r[0] for r in got[0] if 3 in r[3]}


def test_the_ladder_of_models_holds_every_group_out(spark, monkeypatch):
    asked = {}

    def told(df, parts, label, key, model, level, *rest, **more):
        asked[level] = (set(parts), tuple(model))
        return spark.createDataFrame([("x", "A", "A", p, m) for p in parts for m in model], "provision_id string, t string, p string, part string, model string")

    monkeypatch.setattr(models, "evaluate", told)
    got = q_models.split_ladder_models(spark, "/root/testdata/sf0.001").collect()
    groups = q_models._narrow(spark, "/root/testdata/sf0.001", "silver").where("silver is not null and grp is not null").select("grp").distinct().count()
    assert groups > 1 and asked == {level: ({f"{r}|{k}" for r in ("random", "doc", "group") for k in range(groups)}, ("logistic", "svm")) for level in range(4)}
    assert {(r.regime, r.model, r.level, r.n) for r in got} == {(r, m, x, groups) for r in ("random", "doc", "group") for m in ("logistic", "svm") for x in range(4)}


def test_parts_with_terms_of_their_own_do_not_depend_on_how_many_are_stored_at_once(spark, monkeypatch):
    df = _marked(spark, 2, 24).withColumn("fold", F.pmod(F.xxhash64("provision_id"), F.lit(3)))
    plan = {str(f): (f"fold <> {f} and fold <> 9", f"fold = {f}") for f in range(3)}
    monkeypatch.setattr(models, "TERMS", 2)
    monkeypatch.setattr(models.best_terms, "__defaults__", (2,))
    stored, original, got = [], linear.store, []
    monkeypatch.setattr(linear, "store", lambda *a: stored.append(len(a[-1])) or original(*a))
    for most in (1 << 20, 0):
        monkeypatch.setattr(models, "STORED", most)
        monkeypatch.setattr(models, "STORES", 1)
        got.append({(r.provision_id, r.part, r.model): (r.t, r.p) for r in models.evaluate(df, plan, "grp", "provision_id", ("logistic", "svm"), 3, "grp", iterations=6).collect()})
    assert stored == [3, 1, 1, 1] and got[0] == got[1] and len(got[0]) == 2 * df.count()


def test_a_task_of_many_classes_holds_no_columns_in_memory(spark, monkeypatch):
    r, fitted = random.Random(3), []
    rows = [(f"{d:03}{i}", "g", f"d{d:03}", " ".join(f"w{r.randrange(900)}" for _ in range(9)) + f" hall{d}", i % 4) for d in range(250) for i in range(6)]
    df = spark.createDataFrame(rows, "provision_id string, grp string, doc_id string, text string, fold int")
    applied = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: fitted.append(f) or applied(self, f, schema))
    linear.within(df.limit(40), "grp", "doc_id", "fold", 4, "provision_id", "text", 4.0, 4, models.FEATURES)
    task = df.withColumn("c", linear.codes("text", models.FEATURES)).selectExpr("grp g", "provision_id key", "doc_id label", "fold", "c", "0 f").toArrow()
    got = []
    for most in (1 << 22, 1 << 14):
        monkeypatch.setattr(linear, "WIDE", most)
        monkeypatch.setattr(linear, "PIECE", most)
        monkeypatch.setattr(linear, "DENSE", 64)
        monkeypatch.setattr(linear, "KEPT", 0)
        monkeypatch.setattr(linear, "GATHERED", 1 << 14)
        tracemalloc.start()
        got.append((fitted[0](task).sort_by("key").to_pydict(), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    said = [x["p"] for x, _ in got]
    assert len(said[0]) == 500 and sum(a == b for a, b in zip(*said)) >= 495  # the sums are taken in another order
    assert got[1][1] < got[0][1] / 3
