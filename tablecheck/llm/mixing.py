"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Tokens are summed per cell of source, language and topic. The weights of the cells are raked in
turn to the target shares of the three marginals (a window per margin) until the largest error is
below a tolerance. Some rounds are planned at once, and the first that is near enough is taken: a job
and a table per round filled the driver. Few cells are one partition, which no round shuffles. A cell's rate is its raked weight over its tokens. If the mixture
in which the highest rate has probability 1 keeps ``BUDGET`` of the tokens, it is taken. Otherwise a
few small cells would set its size: then ``BUDGET`` of the tokens are kept, cells that are too small
for their weight are kept whole, and the rest is raked again. The error left is in the cells.
Every document is then kept with the probability of its cell, by a uniform number made from its
doc_id, so runs agree.

The topic is the form of the text unless a topic expression is given. Defined cases: null source,
language or topic is a value of its own; null and empty text has no tokens, its cell may have none
at all and then has probability 1. A null doc_id is drawn like any other value; rows that repeat a
doc_id are drawn alike. An empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import WORD_CLASS, written

MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}  # target share: the present one to this power
ROUNDS = 50
AT_ONCE = 4  # rounds in a plan
CELLS = 100_000  # in a partition
BUDGET = 0.5  # share of the tokens that the mixture keeps at least
TOLERANCE = 1e-4
SEED = "mix-1"


def form_of_text() -> Column:
    """A topic made from the text's form: short, listed (short lines) or running text."""
    chars = F.length(F.coalesce("text", F.lit("")))
    lines = 1 + F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n"))
    return (
        F.when(chars < 600, F.lit("short")).when(chars < 120 * lines, F.lit("listed")).otherwise("running")
    )


def tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS)).cast("long")


def _sum(column: str, margin: str) -> Column:
    return F.sum(column).over(Window.partitionBy(margin))


def _split(cells: DataFrame, parts: int) -> DataFrame:
    """The cells of a written table in so many partitions; one needs no shuffle for its windows."""
    return cells.coalesce(parts)


def with_targets(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """_goal_<margin>: target share of the cell's value, its share of the tokens to a power, scaled to 1."""
    goals = {}
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("_all"))
        whole = sums.agg(F.sum(F.pow("_all", F.lit(powers[margin])))).first()[0]
        power = F.pow(_sum("tokens", margin).cast("double"), F.lit(powers[margin]))
        goals[f"_goal_{margin}"] = power / F.lit(whole).cast("double")
    return cells.withColumns(goals)


def _raked(cells: DataFrame, margin: str) -> DataFrame:
    """Weights scaled so that the margin has its target shares; error: how far it was off."""
    goal = F.col(f"_goal_{margin}")
    return (
        cells.withColumn("_now", _sum("weight", margin))
        .withColumn("weight", F.col("weight") * (goal / F.col("_now")))
        .withColumn("error", F.greatest("error", F.abs(goal - F.col("_now"))))
        .drop("_now")
    )


def _capped(cells: DataFrame, share: str) -> DataFrame:
    """Weights of at most the cell's share of the tokens, over the share that is kept."""
    return cells.withColumn("weight", F.least("weight", F.expr(share)))


def _error(cells: DataFrame) -> float:
    """The largest distance of a margin's share from its target."""
    off = [F.abs(F.col(f"_goal_{m}") - _sum("weight", m)) for m in MARGINS]
    return cells.select(F.greatest(*off).alias("_off")).agg(F.max("_off")).first()[0] or 0.0


def _rounds(cells: DataFrame, parts: int, rounds: int, tolerance: float, share: str | None = None) -> DataFrame:
    """Raked until no margin is off by the tolerance; with a share, capped, until no weight moves by it."""
    done = 0
    while done < rounds:
        some = min(AT_ONCE, rounds - done)
        step = cells.withColumn("_steps", F.array().cast("array<struct<weight:double,off:double>>"))
        for _ in range(some):
            step = step.withColumn("_before", F.col("weight")).withColumn("error", F.lit(0.0))
            for margin in MARGINS:
                step = _raked(step, margin)
                if share:
                    step = _capped(step, share)
            off = F.abs(F.col("weight") - F.col("_before")) if share else F.col("error")
            step = step.withColumn(
                "_steps", F.array_append("_steps", F.struct(F.col("weight"), off.alias("off")))
            )
        step = _split(written(step.drop("_before")), parts)
        offs = step.agg(*[F.max(F.col("_steps")[i]["off"]) for i in range(some)]).first()
        near = [i for i, off in enumerate(offs) if off is None or off < tolerance]
        cells = step.withColumn("weight", F.col("_steps")[near[0] if near else some - 1]["weight"]).drop("_steps")
        done += some
        if near:
            break
    return cells


def calibrated(
    cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
    budget: float = BUDGET,
) -> DataFrame:
    """Cells (source, lang, topic, tokens, documents) with weight, probability and the error left."""
    parts = 1 + cells.count() // CELLS
    some = _split(cells.where("tokens > 0"), parts)
    whole = some.agg(F.sum("tokens").cast("double")).first()[0]
    raked = with_targets(some, powers).select(
        *MARGINS, "tokens", "documents", *[f"_goal_{m}" for m in MARGINS],
        (F.col("tokens") / F.lit(whole).cast("double")).alias("weight"), F.lit(0.0).alias("error"),
    )
    raked = _rounds(_split(written(raked), parts), parts, rounds, tolerance)
    tokens, top = raked.agg(F.sum("tokens"), F.max(F.col("weight") / F.col("tokens"))).first()
    left = 0.0
    if top:
        kept = min(1.0, 1.0 / (top * tokens))  # of all tokens, with the highest rate at probability 1
        if kept < budget:
            kept = budget
            share = f"tokens / {kept * tokens!r}D"
            raked = _rounds(_capped(raked, share), parts, rounds, tolerance, share)
            # what the capped cells lack goes to the others, so that the budget is met
            for _ in range(3):
                whole = raked.agg(F.sum("weight")).first()[0]
                raked = _capped(raked.withColumn("weight", F.col("weight") / F.lit(whole)), share)
        left = _error(raked)
        chance = F.least(F.lit(1.0), F.col("weight") * F.lit(kept * tokens) / F.col("tokens"))
    else:
        chance = F.lit(1.0)
    return written(
        raked.select(*MARGINS, "tokens", "documents", F.round("weight", 12).alias("weight"),
                     F.round(chance, 9).alias("probability"))
        .unionAll(
            cells.where("tokens = 0").select(
                *MARGINS, "tokens", "documents", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability")
            )
        )
        .withColumn("error", F.lit(left))
    )


def uniform() -> Column:
    """A number in [0, 1) from the doc_id: twelve hex digits of a digest."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def drawn(docs: DataFrame, topic: Column | None = None, **options) -> DataFrame:
    """Every row of ``docs`` as ``_row`` with its cell, n_tokens, weight, probability and kept."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").alias("_source"), F.col("lang").alias("_lang"),
        (form_of_text() if topic is None else topic).alias("_topic"),
        tokens().alias("n_tokens"), uniform().alias("_draw"),
    )
    cells = written(
        rows.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")
        )
    )
    weights = calibrated(cells, **options).select(
        *[F.col(m).alias(f"_cell_{m}") for m in MARGINS], "weight", "probability"
    )
    # the planner broadcasts the cells if their files are small enough, else joins by shuffle
    same = [F.col(f"_{m}").eqNullSafe(F.col(f"_cell_{m}")) for m in MARGINS]
    joined = rows.join(weights, same[0] & same[1] & same[2])
    return joined.withColumn("kept", F.col("_draw") < F.col("probability"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mixture keeps, with the columns of ``docs``."""
    return drawn(docs, **options).where("kept").select("_row.*")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept."""
    plain = docs.select("doc_id", "text", "source", "lang")
    return drawn(plain, **options).select(
        F.col("_row.doc_id").alias("doc_id"), *[F.col(f"_{m}").alias(m) for m in MARGINS],
        "n_tokens", "weight", "probability", "kept",
    )
