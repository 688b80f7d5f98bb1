"""Mixing sources to target weights, in DataFrame operations only.

Capped water-filling gives each source a target: sources share the total by
weight, a source that would be read more than ``max_epochs`` times is clamped
there, and what it cannot take is shared by the others, by weight again, until
no source is above its cap. A source's target is then met with whole repetitions
of all its documents and one partial repetition: the documents that come first in
a seeded order, up to the one whose middle lies beyond the target.

The partial repetition needs running sums in a seeded order. Documents are dealt
by hash into slots; slot sums are added up first, and only the documents of the one
slot per source that holds the cut are put in order, so a source with a third of all
rows is no single group anywhere. What comes out is one hash per source, below which
documents are drawn once more: drawing is a narrow step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowline.llm.shared import WORD
from sparrowline.session import materialise

_SLOT_BITS = 10


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic(weights: tuple[float, ...]) -> Callable[[DataFrame], DataFrame]:
    """Weights by place: sources in code point order, null last, take ``weights`` in turn.

    The window holds one row per source.
    """

    def weigh(sources: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        values = F.array(*[F.lit(float(w)) for w in weights])
        return sources.withColumn("weight", F.get(values, F.pmod(place, F.lit(len(weights)))))

    return weigh


def water_fill(weighted: DataFrame, max_epochs: float, share: float = 1.0) -> DataFrame:
    """Add ``target`` (double) to ``source``, ``source_size``, ``weight``.

    The targets add up to ``share`` of all sizes, or to the sum of the caps if that
    is less. Weights that are null or not positive count as 0: such a source gets
    nothing. Every round is one small aggregate over the sources; the set of clamped
    sources only grows, and the rounds end when it no longer does.
    """
    if max_epochs <= 0 or share < 0:
        raise ValueError("need max_epochs > 0 and share >= 0")
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    weighted = materialise(weighted.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level, clamped = (goal / weights if weights else 0.0), -1
    while weights:
        above = (F.col("weight") > 0) & (F.col("weight") * F.lit(level) >= cap)
        count, taken, free = weighted.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if count == clamped or not free:
            break
        clamped, level = count, max(level, (goal - (taken or 0.0)) / free)
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap))


def _cuts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source (``cut_source``) the least hash, ``cut``, that its partial repetition leaves out."""
    slot = F.shiftrightunsigned("order", 64 - _SLOT_BITS).cast("int").alias("slot")
    slots = sizes.groupBy(F.col("source").alias("cut_source"), slot).agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("cut_source").orderBy("slot"))
    over = slots.withColumn("upto", upto).join(goals, F.col("cut_source").eqNullSafe(F.col("source")))
    over = over.filter(F.col("upto") > F.col("rest")).groupBy("cut_source")
    over = over.agg(
        F.min("slot").alias("cut_slot"),
        F.min_by(F.col("upto") - F.col("held"), "slot").alias("before"),
        F.first("rest").alias("rest"),
    )
    edge = sizes.join(over, F.col("source").eqNullSafe(F.col("cut_source")) & (slot == F.col("cut_slot")))
    edge = edge.groupBy("cut_source", "order").agg(
        F.sum("size").alias("held"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    until = F.sum("held").over(Window.partitionBy("cut_source").orderBy(_unsigned(F.col("order"))))
    edge = edge.withColumn("middle", F.col("before") + until - F.col("held") / 2)
    drawn = F.max(F.when(F.col("middle") <= F.col("rest"), _unsigned(F.col("order"))))
    return edge.groupBy("cut_source").agg(F.coalesce(drawn + 1, F.min(_unsigned(F.col("order")))).alias("cut"))


def _unsigned(order: Column) -> Column:
    """Hashes in the order of their slots: the sign bit counts as the highest."""
    return order.bitwiseXOR(F.lit(-(1 << 63)))


def mix_sources(
    docs: DataFrame,
    weigh: Callable[[DataFrame], DataFrame],
    *,
    source: str = "source",
    size: Column | None = None,
    keys: tuple[str, ...] = ("doc_id",),
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = 20_24,
) -> DataFrame:
    """All rows of ``docs`` with ``source_size``, ``target``, ``copies`` and ``taken``.

    ``weigh`` is given one row per source (``source``, ``source_size``; null is a source)
    and adds ``weight``; ``size`` is a document's size, by default ``word_count`` of
    ``text``. ``copies`` says how often the mix holds the document, ``taken`` is
    ``copies * size``. The order of the partial repetition follows a hash of ``keys`` and
    ``seed``, so the same rows always give the same mix, and a source misses its target by
    half of one document at most.

    A null size counts as 0, null keys are hashed like any value, rows repeated under
    one key are drawn together. Empty tables give empty results. Columns of ``docs``
    named like an output column are replaced.
    """
    outputs = ("source_size", "target", "copies", "taken")
    kept = [name for name in docs.columns if name not in outputs]
    size = F.coalesce(word_count(F.col("text")) if size is None else size, F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    sizes = docs.select(F.col(source).alias("source"), order.alias("order"), size.alias("size"))
    sizes = materialise(sizes, "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = water_fill(weigh(totals), max_epochs, share).select("source", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = _cuts(sizes, goals)
    goals = goals.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    goals = goals.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "source_size", "target", "whole", "cut")])
    rows = docs.select(*kept, order.alias("_mix_order"), size.alias("_mix_size"))
    rows = rows.join(materialise(goals, "mix-goals"), F.col(source).eqNullSafe(F.col("_mix_source")))
    # Without a cut the whole source fits into the rest, which then is 0 words or all of them.
    more = F.coalesce((_unsigned(F.col("_mix_order")) < F.col("_mix_cut")).cast("long"), F.lit(0))
    copies = F.col("_mix_whole") + more
    return rows.select(
        *kept,
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_mix_size")).alias("taken"),
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, without the added columns."""
    kept = [name for name in mixed.columns if name not in ("source_size", "target", "copies", "taken")]
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    drawn = mixed.filter(F.col("copies") > 0).select(*kept, F.explode(copies).alias("_mix_copy"))
    return drawn.drop("_mix_copy")
