"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the budget in proportion to its weight, but can give at most
``max_epochs`` times its size. Sources above that bound are clamped and what they leave is shared
among the rest by weight, until no target is above its bound: the exact water level, found on one
row per source. Documents are then taken in a seeded order (a hash of doc_id and text, ties broken)
with whole repetitions for every document and one more for the documents at the head of the order, up
to the point where the source's words come nearest to its target.

That point is found without sorting a source: words are summed per source and 12-bit slice of the
hash, the slice in which the target falls is summed again by its next 12 bits, and so on. Every sum
is combined on the map side, so a source that holds a third of all rows costs no more than others.

Empty and null texts have size 0. A null source is a source of its own and comes last. Rows that repeat
a doc_id (or have none) are ordered by their texts too, and equal ones by their place in the input, so a source
of nothing but copies still comes near its target. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, joined

#: Bits of the seeded order that one level looks at, and the levels, which reach into the bits that break ties.
_BITS, _LEVELS, _TIE_BITS = 12, 5, 16


def water_fill(sizes: dict, weights: dict, budget: float, max_epochs: float) -> dict:
    """The target of each source: weight-proportional shares of ``budget``, none above ``max_epochs`` times its size."""
    caps = {s: max_epochs * n for s, n in sizes.items()}
    targets, free, left = {}, [s for s in sizes if weights[s] > 0], float(min(budget, sum(caps.values())))
    targets = {s: 0.0 for s in sizes}
    while free:
        level = left / sum(weights[s] for s in free)
        full = [s for s in free if level * weights[s] >= caps[s]]
        if not full:
            for s in free:
                targets[s] = level * weights[s]
            break
        for s in full:
            targets[s] = float(caps[s])
            left -= caps[s]
        free = [s for s in free if level * weights[s] < caps[s]]
        left = max(left, 0.0)
    return targets


def cyclic_weights(sources: list, cycle: tuple = (5.0, 2.0, 1.0)) -> dict:
    """Weights that repeat over the sources in code-point order, null last."""
    ordered = sorted(s for s in sources if s is not None) + [s for s in sources if s is None]
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def mix_plan(documents: DataFrame, weights=cyclic_weights, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, tie: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (doc_id, source, size, _at) and a row per source with its target and where its order is cut.

    ``tie`` orders rows of equal doc_id and text; by default their place in the input, which the written sizes fix.
    ``weights``: a dict by source, or a function of the list of sources that returns one. One row per
    source comes to the driver; sources are a configured set, not data of the size of the corpus.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    tie = F.monotonically_increasing_id() if tie is None else tie
    sized = scratch.keep(documents.select("doc_id", "source", _size().alias("size"), _order(seed, tie).alias("_at")), "sized")
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    weight = weights(list(totals)) if callable(weights) else {s: weights.get(s, 0.0) for s in totals}
    targets = water_fill(totals, weight, share * sum(totals.values()), max_epochs)
    whole = {s: min(int(targets[s] // n), int(max_epochs)) if n else 0 for s, n in totals.items()}
    schema = "source string, source_size long, target double, _whole int, _need double"
    plan = spark.createDataFrame([(s, n, targets[s], whole[s], targets[s] - whole[s] * n) for s, n in totals.items()], schema)
    plan = scratch.keep(plan.coalesce(1), "plan")
    return sized, _cut_points(sized, plan, scratch)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _order(seed: int, tie: Column) -> Column:
    """A seeded hash of doc_id and text, whose last bits are those of a hash of ``tie``."""
    first = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    last = F.xxhash64(F.lit(seed + 1), tie)
    return first.bitwiseAND(F.lit(-(1 << _TIE_BITS))).bitwiseOR(last.bitwiseAND(F.lit((1 << _TIE_BITS) - 1)))


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to rows that have source, size and __tw_at."""
    cuts = cuts.select(F.col("source").alias("__tw_source"), "source_size", "target", F.col("_whole").alias("__tw_whole"), F.col("_cut").alias("__tw_cut"))
    out = joined(rows.drop("source_size", "target", "copies", "taken"), cuts, F.col("source").eqNullSafe(F.col("__tw_source")))
    copies = F.col("__tw_whole") + (F.col("__tw_at") < F.col("__tw_cut")).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("__tw_source", "__tw_whole", "__tw_cut", "__tw_at")


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """Each row's doc_id, source, size, source_size, target, copies and taken."""
    sized, cuts = mix_plan(documents, **options)
    return _taken(sized.withColumnRenamed("_at", "__tw_at"), cuts)


def apply_mix(documents: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The rows that the mix takes, with all their columns and size, source_size, target, copies and taken.

    Input columns of these five names are replaced. Rows that are equal in every column are taken alike.
    """
    plain = [f.name for f in documents.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    _, cuts = mix_plan(documents, seed=seed, tie=tie, **options)
    rows = documents.withColumn("__tw_at", _order(seed, tie)).withColumn("size", _size())
    return _taken(rows, cuts).filter("copies > 0")


def _cut_points(sized: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``_cut``: documents whose hash is below it are taken once more."""
    low = F.lit(-(2**63)).cast("long")
    found = plan.withColumn("_cut", low).withColumn("_under", F.lit(0.0))
    for level in range(_LEVELS):
        shift = 64 - _BITS * (level + 1)
        lo, hi = F.col("b._cut"), F.shiftright(F.col("b._cut"), shift + _BITS)
        inside = F.col("a.source").eqNullSafe(F.col("b.source"))
        if level:
            inside &= F.shiftright(F.col("a._at"), shift + _BITS) == hi
        slices = joined(sized.filter("size > 0").alias("a"), found.alias("b"), inside).groupBy("b.source", F.shiftright(F.col("a._at"), shift).alias("_slice")).agg(F.sum("a.size").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        slices = slices.withColumn("_before", F.coalesce(before, F.lit(0)).cast("double"))
        # the slice in which the need falls: the last that begins at or below it
        at = F.max_by(F.struct("s._slice", "s._before", "s._n"), "s._slice").alias("_hit")
        reached = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("b._under") + F.col("s._before") <= F.col("b._need"))
        hit = joined(slices.alias("s"), found.alias("b"), reached).groupBy("b.source").agg(at)
        moved = found.alias("b").join(hit.alias("h"), F.col("b.source").eqNullSafe(F.col("h.source")), "left")
        cut = F.shiftleft(F.col("h._hit._slice"), shift)
        under = F.col("b._under") + F.col("h._hit._before")
        if level == _LEVELS - 1:  # with or without the last slice, whichever is nearer
            more = (F.col("b._need") - under) * 2 > F.col("h._hit._n")
            last = F.shiftright(F.lit(2**63 - 1).cast("long"), shift)
            cut = F.when(more & (F.col("h._hit._slice") < last), F.shiftleft(F.col("h._hit._slice") + 1, shift)).when(more, F.lit(2**63 - 1).cast("long")).otherwise(cut)
        found = moved.select("b.source", "b.source_size", "b.target", "b._whole", "b._need", F.coalesce(cut, lo).alias("_cut"), F.coalesce(under, F.col("b._under")).alias("_under"))
        found = scratch.keep(found.coalesce(1), f"cut{level}")
    return found
