"""Quality rules as a short-circuit cascade, in column expressions only.

The base figures are computed for every document. The further rules form one CASE expression, which
Spark evaluates branch by branch, so a rejected document costs nothing more. The order comes from a
sample of about ``SAMPLE_ROWS`` rows: every rule is run alone over copies of the rows that pass the base
rule, and the next rule is the one with the most rejections per second among the rows that the rules
before it leave. The order changes cost, never the verdict.

Defined cases: null and empty text has no words and fails the base rule. Rows are judged one by one,
so repeated rows, ties, null ids and extra columns change nothing. An empty table gives an empty
result (the sample is empty too and the rules keep their given order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import SPACE_CLASS

SAMPLE_ROWS = 2000
COPIES, REPEATS = 20, 3  # a rule is timed over so many copies of the sample, so often
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects``: a column over text, n_words, word_chars, n_symbols, n_lines, n_dup_lines."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    upper = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    letters = F.length(F.regexp_replace("_text", "[^A-Za-z]+", ""))
    loud = F.length(F.regexp_replace("_text", "[^!?]+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * n),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("upper_case", 100 * upper > 50 * letters),
        Rule("exclamations", 100 * loud > 30 * n),
    ]


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the base columns of each row."""
    words = F.array_remove(F.split("_text", f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("_n") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
    )
    # positions of the windows whose hash stands beside an equal one after sorting
    ordered = F.col("_ordered")
    repeats = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"])
        | (x["h"] == F.get(ordered, k + 1)["h"]),
    )
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(
            starts,
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    figures = [
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ]
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_words", words)
        .withColumn("_n", F.size("_words"))
        .withColumn("_lines", lines)
        .withColumn("_windows", F.when(F.col("_n") >= WINDOW, window))
        .withColumn(
            "_ordered",
            F.when(
                some,
                F.array_sort(
                    F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
                ),
            ),
        )
        .withColumn("_starts", F.array_sort(F.transform(repeats, lambda x: x["i"])))
        # behind a generator, so that filters on the figures do not repeat their expressions
        .select("doc_id", "_text", F.inline(F.array(F.struct(*figures))))
        .withColumn("base_failed", base_failed())
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def ordered_by_gain(docs: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second, each among what the rules before it leave of a sample.

    The sample's share of the rows follows their number, so it has about ``SAMPLE_ROWS`` rows at any size,
    spread over at most as many tasks as the session runs at once; no task gathers it. Only the speed of
    the cascade depends on it.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return rules
    share = min(1.0, SAMPLE_ROWS / total)
    sample = (
        base_figures(docs.sample(fraction=share, seed=7))
        .where("not base_failed")
        .coalesce(docs.sparkSession.sparkContext.defaultParallelism)
        .persist()
    )
    try:
        rejects = [F.coalesce(r.rejects, F.lit(False)).alias(f"_{i}") for i, r in enumerate(rules)]
        # at most one row per row of the sample
        patterns = [tuple(row) for row in sample.select(*rejects).groupBy(
            *(f"_{i}" for i in range(len(rules)))).count().collect()]
        copies = sample.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), COPIES)))

        def seconds(column: Column) -> float:
            start = time.perf_counter()
            copies.agg(F.count_if(column)).first()
            return time.perf_counter() - start

        columns = [F.col("base_failed"), *rejects]  # the first tells what a job costs without a rule
        idle, *timed = (median(x) for x in zip(*([seconds(c) for c in columns] for _ in range(REPEATS))))
        cost = [max(t - idle, 0.001) for t in timed]
        order, left = [], list(range(len(rules)))
        while left:
            def gain(i: int) -> tuple[float, str]:
                return -sum(p[-1] for p in patterns if p[i]) / cost[i], rules[i].name

            best = min(left, key=gain)
            order.append(rules[best])
            left.remove(best)
            patterns = [p for p in patterns if not p[best]]
        return order
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, in this order; null if none does."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return verdict


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base columns, base_failed, kept and rejected_by (the first rule in the chosen order)."""
    order = ordered_by_gain(docs, default_rules() if rules is None else rules)
    return (
        base_figures(docs)
        .withColumn("rejected_by", cascade(order))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("_text", "n_lines")
    )
