"""Human and model annotation: coded queues, repeated showings, reply packages, scorers that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.functions import patterns as P
from tesselith.functions import text as T
from tesselith.operators import measures as M
from tesselith.operators.passages import first_wins

#: What a coder writes where an excerpt cannot be judged.
UNJUDGED = "INSUFFICIENT_CONTEXT"


def queue(df: DataFrame, key: str, heading: str = "heading", text: str = "text") -> DataFrame:
    """``df`` with heading and text cut as a sheet shows them (120 and 1,800 letters), which is the sheet's own format."""
    return df.withColumns({heading: F.substring(heading, 1, 120), text: F.substring(text, 1, 1800)})


def coded(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """The queue's ``items`` (i, ...) with their ``label`` from the sheet (i, label); items that nobody coded are left out."""
    return items.join(sheet.where("label is not null").select("i", "label"), "i")


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, second, blind): the two labels of every key that was shown exactly twice and coded both times; blind if no suggestion was shown."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n"), F.min_by("label", "i").alias("first"), F.max_by("label", "i").alias("second"), F.count_if(F.col("suggested").isNotNull()).alias("s"))
    return twice.where("n = 2").select(key, "first", "second", (F.col("s") == 0).alias("blind"))


def reliability(pairs: DataFrame) -> DataFrame:
    """(which, n, raw, kappa) of repeated showings, of all and of blind ones."""
    out = []
    for name, rows in (("all", pairs), ("blind_only", pairs.where("blind"))):
        k = M.kappa(M.confusion(rows, "first", "second"))
        out.append(k.select(F.lit(name).alias("which"), "n", F.col("observed").alias("raw"), "kappa"))
    return out[0].unionByName(out[1])


def gold(rows: DataFrame, key: str) -> DataFrame:
    """(key, gold): the first label of every key that is a judgement; later showings count only where earlier ones could not be judged."""
    return first_wins(rows.where(F.col("label") != UNJUDGED).select(key, "i", "label"), [key], ["i"]).select(key, F.col("label").alias("gold"))


def agreement(rows: DataFrame, rule: str, model: str) -> DataFrame:
    """(shown, n, rule_n, rule_rate, model_rate, accepted): how often annotators agree with the coder, blind and with a suggestion shown.

    Rows without a rule label are left out of the rule's rate; a row without a model label disagrees.
    """
    judged = rows.where(F.col("label") != UNJUDGED)
    same = lambda c: (F.col(c) == F.col("label")).cast("int")
    return judged.groupBy(F.when(F.col("suggested").isNull(), "blind").otherwise("suggested").alias("shown")).agg(
        F.count("*").alias("n"), F.count(rule).alias("rule_n"), F.avg(same(rule)).alias("rule_rate"), F.avg(F.coalesce(same(model), F.lit(0))).alias("model_rate"), F.avg(same("suggested")).alias("accepted"))


def with_gold(corpus: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``corpus`` with its ``gold`` column updated from ``labels`` (key, gold); what has no new label keeps the old one."""
    return corpus.join(labels.withColumnRenamed("gold", "_new"), key, "left").withColumn("gold", F.coalesce("_new", "gold")).drop("_new")


def replies(texts: DataFrame, tag: str, text: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answers: tag, n, label; counts: tag, n_answers, n_bad). The first line "[n] LABEL" of each number with a known label counts; other lines that are not blank are bad."""
    lines = texts.select(tag, F.posexplode(F.split(T.blank(F.col(text)), "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    read = lines.withColumn("n", F.nullif(F.regexp_extract("line", r"^\[(\d+)\]\s*[A-Z_]+$", 1), F.lit("")).cast("int")).withColumn("label", F.regexp_extract("line", r"^\[\d+\]\s*([A-Z_]+)$", 1))
    ok = F.col("n").isNotNull() & F.col("label").isin(labels)
    answers = first_wins(read.where(ok).select(tag, "n", "pos", "label"), [tag, "n"], ["pos"]).select(tag, "n", "label")
    counts = read.groupBy(tag).agg(F.count("*").alias("_all")).join(answers.groupBy(tag).agg(F.count("*").alias("n_answers")), tag, "left")
    return answers, counts.select(tag, F.coalesce("n_answers", F.lit(0)).alias("n_answers"), (F.col("_all") - F.coalesce("n_answers", F.lit(0))).alias("n_bad"))


def answered(index: DataFrame, answers: DataFrame) -> DataFrame:
    """The items of a reply package (tag, n, ...) with their ``pred``, the answer of their number; items without an answer have none."""
    return index.join(answers.withColumnRenamed("label", "pred"), ["tag", "n"], "left")


def overlap_score(texts: pd.Series, hypotheses: list[str]) -> pd.DataFrame:
    """A stand-in for an entailment model: the share of a hypothesis' words that a text holds, smoothed, so that rows sum to one."""
    wanted = [set(h.lower().split()) for h in hypotheses]
    rows = []
    for t in texts.fillna(""):
        words = set(t.lower().split())
        raw = [0.01 + len(w & words) / max(1, len(w)) for w in wanted]
        rows.append([x / sum(raw) for x in raw])
    return pd.DataFrame(rows)


def zero_shot(df: DataFrame, key: str, text: str, hypotheses: dict[str, str], score: Callable[[pd.Series, list[str]], pd.DataFrame] = overlap_score, letters: int = 1200) -> DataFrame:
    """(key, label, probs): the most likely label of each text, with every label's probability; of equal ones the first hypothesis wins.

    ``score`` is any model: texts and hypotheses in, a row of probabilities for each text out. It sees the first
    ``letters`` letters, the window of such models. Batches of Arrow rows; nothing is crossed or shuffled.
    """
    names, says = list(hypotheses), list(hypotheses.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = score(b["text"], says).to_numpy()
            best = p.argmax(axis=1)
            yield pd.DataFrame({"key": b["key"], "label": [names[k] for k in best], "probs": [dict(zip(names, map(float, row))) for row in p]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.substring(text, 1, letters).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, label string, probs map<string,double>").withColumnRenamed("key", key)


def references(df: DataFrame, rule: str = "rule_label", model: str = "nli_label", default: str = "PROCEDURE") -> DataFrame:
    """``df`` with the two predictions that need no training, ``pred_rule`` and ``pred_model``; where one is silent it says the default."""
    return df.withColumns({"pred_rule": F.coalesce(rule, F.lit(default)), "pred_model": F.coalesce(model, F.lit(default))})


#: What each function label says of a text, for scorers.
HYPOTHESES = {k: f"this text states {k.lower().replace('_', ' ')}" for k in P.LABELS}
