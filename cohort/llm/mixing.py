"""Mixing sources to target weights: hash-threshold histograms, DataFrame expressions only.

Each row has a pseudo-random 60-bit hash.  A source's target of ``T`` words over ``S`` words of its own means
``floor(T / S)`` whole copies of every row plus a budget of the rest, which goes to the rows whose hash lies below a
threshold.  Budgets are nested: a larger target of the same source takes a superset of rows.  The threshold is found
without a sort: words are summed by source and the hash's top ``BITS`` bits; the running sum of these
histograms shows the bucket in which the budget ends; only the rows of that boundary bucket are summed again by
the next bits, until a bucket is a single hash.  Histograms have at most sources x 2^BITS rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, ref, word_count

#: Weights by order of source name (code points, null last), repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
HASH_BITS = 60
BITS = 12
#: Up to so many sources, the table with a row for each (some 60 bytes) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def row_hash(*columns: Column) -> Column:
    """60 pseudo-random bits of a row: the same on every run, cluster and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """``sizes(source, size)`` one row a source -> ``(source, source_size, target)``.

    ``share`` of all words is split by weight; a target above ``max_epochs`` times its source's size stops there and
    the excess is reshared by weight among the others until none is above.  The fixed point is water-filling:
    with sources ordered by cap / weight, those before some place are at their cap and the others share the rest.
    One row a source is ordered here, not the data.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.select("source", F.col("size").alias("source_size"), weight.alias("w"), (F.col("size") * float(max_epochs)).alias("cap"))
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(full) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    filled = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # the first place that is free sets the level for itself and all after it
    water = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(full)["level"]
    return filled.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))).alias("target")
    )


def _with_source(rows: DataFrame, per_source: DataFrame, source: str, small: bool) -> DataFrame:
    """Join on the source, null equal to null; ``per_source`` (key ``src``) is broadcast only if it was counted small."""
    right = F.broadcast(per_source) if small else per_source
    return rows.join(right, ref(source).eqNullSafe(F.col("src")))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows(source, size, h)`` and targets -> ``(src, source_size, target, epochs, below)``, one row a source.

    Rows with ``h < below`` get ``epochs + 1`` copies, the others ``epochs``.  ``below`` is placed so that the words
    taken are as near to the target as a whole row allows.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = checkpointed(
        targets.withColumn("epochs", whole).select(
            F.col("source").alias("src"), "source_size", "target", "epochs",
            (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"),
            F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("last"),
        )
    )
    small = state.count() <= BROADCAST_SOURCES
    inside = rows.where("size > 0").select("source", "size", "h")
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        if shift < HASH_BITS - BITS:  # only the bucket in which the budget ends goes on
            inside = checkpointed(
                _with_source(inside, state.select("src", "below"), "source", small)
                .where(F.shiftright("h", shift + BITS) == F.shiftright("below", shift + BITS))
                .select("source", "size", "h")
            )
        words = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = words.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        over = (
            _with_source(upto, state.select("src", "budget"), "source", small)
            .where(F.col("upto") > F.col("budget"))
            .groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("cut"))
        )
        cut = F.col("cut")
        state = checkpointed(
            state.join(over, F.col("source").eqNullSafe(F.col("src")), "left").select(
                "src", "source_size", "target", "epochs",
                F.when(cut.isNull(), F.col("budget")).otherwise(F.col("budget") - (cut["upto"] - cut["words"])).alias("budget"),
                F.when(cut.isNull(), F.col("below")).otherwise(F.call_function("shiftleft", cut["bucket"], F.lit(shift))).alias("below"),
                F.when(cut.isNull(), F.lit(0).cast("long")).otherwise(cut["words"]).alias("last"),
            )
        )
    # the bucket is one hash now; it is taken if that comes nearer to the target
    nearer = (F.col("last") - F.col("budget") < F.col("budget")).cast("long")
    return state.select("src", "source_size", "target", "epochs", (F.col("below") + nearer).alias("below"))


def _plan(rows: DataFrame) -> tuple[DataFrame, bool]:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    plan = checkpointed(thresholds(rows, source_targets(sizes)))
    return plan, plan.count() <= BROADCAST_SOURCES


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        ref(id_col).alias("id"), ref(source_col).alias("source"),
        word_count(ref(text_col)).alias("size"), row_hash(ref(id_col), ref(text_col)).alias("h"),
    )


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row: words, its source's words and target, words the mix takes.

    Null texts have size 0; null is a source of its own, last in order; repeated rows (same id and text) share a hash
    and are taken or left together.  Extra columns are ignored.  An empty table gives an empty result.
    """
    rows = checkpointed(_narrow(docs, id_col, text_col, source_col))
    plan, small = _plan(rows)
    copies = F.col("epochs") + (F.col("h") < F.col("below")).cast("long")
    return _with_source(rows, plan, "source", small).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows themselves, all columns, each repeated as often as the mix takes it."""
    rows = checkpointed(_narrow(docs, id_col, text_col, source_col).drop("id"))
    plan, small = _plan(rows)
    src, epochs, below, copy = fresh(docs, "src_", "epochs_", "below_", "copy_")
    per_source = plan.select(F.col("src").alias(src), F.col("epochs").alias(epochs), F.col("below").alias(below))
    right = F.broadcast(per_source) if small else per_source
    copies = ref(epochs) + (row_hash(ref(id_col), ref(text_col)) < ref(below)).cast("long")
    return (
        docs.join(right, ref(source_col).eqNullSafe(ref(src)))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*[ref(c) for c in docs.columns])
    )
