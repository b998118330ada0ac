"""Mixing sources to target weights, in built-in expressions only.

Token shares p of the sources are tempered to weights w ~ p ** a. The exponent a is bisected: the flattest mix that
repeats no source more than ``max_repeats`` times, or, with ``entropy``, one whose entropy (nats) is at most that.
The budget is the smallest in which every source is used whole at least once, so the mix repeats small sources and
drops nothing; ``budget`` (tokens) asks for another size, in which large sources may be used in part.

A source with weight w is due ``w * budget / tokens`` epochs. Whole epochs take every document; the last, partial
one takes the source's blocks (4,096 by a hash of the document id) in a random order of its own, as far as its
budget reaches. So only counts per (source, block) are ever ordered, never the documents of a source, and a source
that holds a third of all rows is spread over 4,096 join keys.

Defined results: a null source is a source of its own; a null or empty text has no tokens; a source without tokens
is used once, as its weight is 0; repeated rows are repeated documents of one block; a null id is hashed as the
empty text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesieve.llm.columns import let, n_words

#: Hexadecimal digits of the hash that name a block: 16 ** 3 = 4,096 blocks.
BLOCK_DIGITS = 3
STEPS = 60


def _weights(p: Column, a: Column) -> Column:
    """Weights p ** a, not normalised, relative to the largest share."""
    top = F.array_max(p)
    return F.transform(p, lambda x: F.when(x > 0, F.pow(x / top, a)).otherwise(F.lit(0.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _epochs(p: Column, a: Column, budget: float | None) -> Column:
    """Times each source is used."""
    top = F.array_max(p)

    def times(w: Column) -> Column:
        scale = F.lit(1.0) if budget is None else F.lit(float(budget)) / top / _sum(w)
        return F.zip_with(p, w, lambda x, y: F.when(x > 0, y * scale * top / x).otherwise(F.lit(1.0)))

    return let(_weights(p, a), times)


def _entropy(p: Column, a: Column) -> Column:
    def of(w: Column) -> Column:
        return let(
            _sum(w), lambda s: -_sum(F.transform(w, lambda x: F.when(x > 0, x / s * F.log(x / s)).otherwise(0.0)))
        )

    return let(_weights(p, a), of)


def exponent(p: Column, max_repeats: float, entropy: float | None, budget: float | None) -> Column:
    """The smallest exponent in [0, 1] that keeps the limit, to 60 bisections; 1 if none does."""

    def too_flat(a: Column) -> Column:
        if entropy is not None:
            return _entropy(p, a) > entropy
        return F.array_max(_epochs(p, a, budget)) > max_repeats

    def step(bounds: Column, _: Column) -> Column:
        middle = (bounds["lo"] + bounds["hi"]) / 2
        return let(
            middle,
            lambda m: F.when(too_flat(m), F.struct(m.alias("lo"), bounds["hi"].alias("hi"))).otherwise(
                F.struct(bounds["lo"].alias("lo"), m.alias("hi"))
            ),
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda b: b["hi"])
    return F.when(too_flat(F.lit(0.0)), found).otherwise(F.lit(0.0))


def _block(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, BLOCK_DIGITS), 16, 10).cast("int")


def _draw(source: Column, copy: Column, block: Column) -> Column:
    """The key that orders the blocks of one epoch of a source."""
    return F.md5(F.concat_ws("/", F.coalesce(source, F.lit("")), copy.cast("string"), block.cast("string")))


def source_plan(
    blocks: DataFrame, max_repeats: float = 2.0, entropy: float | None = None, budget: float | None = None
) -> DataFrame:
    """One row per source: tokens, exponent, weight and epochs. One array of sources is all that meets in a task."""
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    gathered = sources.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    shares = F.transform("all", lambda s: s["tokens"].cast("double"))
    planned = let(
        shares,
        lambda p: let(
            exponent(p, max_repeats, entropy, budget),
            lambda a: F.struct(a.alias("exponent"), _weights(p, a).alias("w"), _epochs(p, a, budget).alias("e")),
        ),
    )
    planned = gathered.where(F.size("all") > 0).select("all", planned.alias("plan"))
    rows = planned.select(
        F.col("plan.exponent").alias("exponent"),
        _sum(F.col("plan.w")).alias("total"),
        F.explode(F.arrays_zip("all", F.col("plan.w").alias("w"), F.col("plan.e").alias("e"))).alias("s"),
    )
    return rows.select(
        F.col("s.all.source").alias("source"),
        F.col("s.all.tokens").alias("tokens"),
        "exponent",
        F.when(F.col("total") > 0, F.col("s.w") / F.col("total")).otherwise(0.0).alias("weight"),
        F.col("s.e").alias("epochs"),
    )


def block_copies(
    docs: DataFrame,
    id_col: str,
    source_col: str,
    text_col: str,
    max_repeats: float = 2.0,
    entropy: float | None = None,
    budget: float | None = None,
) -> DataFrame:
    """How often each (source, block) is used, with the source's weight and epochs."""
    blocks = (
        docs.select(
            F.col(source_col).cast("string").alias("source"),
            _block(F.col(id_col)).alias("block"),
            n_words(F.col(text_col)).alias("n"),
        )
        .groupBy("source", "block")
        .agg(F.sum("n").alias("tokens"))
    )
    plan = source_plan(blocks, max_repeats, entropy, budget).withColumnsRenamed(
        {"source": "plan_source", "tokens": "source_tokens"}
    )
    joined = blocks.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    whole = F.floor("epochs")
    share = F.col("epochs") - whole
    order = Window.partitionBy("source").orderBy(_draw(F.col("source"), whole, F.col("block")), "block")
    reached = F.sum("tokens").over(order) <= share * F.col("source_tokens")
    return joined.select(
        "source", "block", "exponent", "weight", "epochs",
        (whole + F.when((share > 0) & reached, 1).otherwise(0)).cast("long").alias("copies"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: float = 2.0,
    entropy: float | None = None,
    budget: float | None = None,
    result: str | None = "mixed",
) -> DataFrame:
    """The rows of the mix: every column of ``docs`` and a struct ``result`` (copy, block, draw, weight, epochs).

    ``draw`` orders the blocks of a copy at random, each copy anew. A column of ``docs`` named like the result is
    replaced; without a result's name the columns are those of ``docs``.
    """
    copies = block_copies(docs, id_col, source_col, text_col, max_repeats, entropy, budget)
    copies = copies.select(F.struct("*").alias("mix plan"))
    plan = F.col("mix plan")
    joined = docs.join(
        copies,
        F.col(f"`{source_col}`").cast("string").eqNullSafe(plan["source"])
        & (_block(F.col(f"`{id_col}`")) == plan["block"]),
    )
    each = joined.where(plan["copies"] > 0).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), plan["copies"])).alias("mix copy")
    )
    mixed = F.struct(
        F.col("mix copy").alias("copy"),
        plan["block"].alias("block"),
        _draw(F.col(f"`{source_col}`").cast("string"), F.col("mix copy"), plan["block"]).alias("draw"),
        plan["weight"].alias("weight"),
        plan["epochs"].alias("epochs"),
    )
    own = [F.col(f"`{c}`") for c in docs.columns if c != result]
    return each.select(*own, mixed.alias(result)) if result else each.select(*own)
