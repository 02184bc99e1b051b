"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions: sizes and per-source sums are partial aggregates, the water level is found
in a table of one row per source, and the fractional part is a systematic sample whose running sums
are taken first over hash slices and then inside each slice, so that no source sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import n_words, same, saved, table

WEIGHTS = (5, 2, 1)
#: Rows that one hash slice of a source holds on average, at most; the running sum inside it is one task's work.
SLICE_ROWS = 50_000
MIN_SLICES = 1024


def targets(sizes: DataFrame, share_num: int = 3, share_den: int = 2, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Capped water-filling over ``sizes(source, source_size)``: adds ``target``.

    The mix wants ``share_num/share_den`` of all sizes. A source gets level * weight, clamped at
    ``cap`` times its size; what it can't take is shared again by weight. Ordered by cap / weight the
    clamped sources are a prefix, so prefix sums give the level that repeated clamping would reach.
    Integers up to the last division keep the result the same on every run.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = sizes.withColumn("weight", weight.cast("long"))
    t = t.withColumns({
        "caps": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
        "used": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all_size": F.sum("source_size").over(whole),
        "all_weight": F.sum("weight").over(whole),
    })
    t = t.withColumns({"num": share_num * F.col("all_size") - share_den * F.col("caps"), "den": share_den * (F.col("all_weight") - F.col("used"))})
    t = t.withColumn("clamped", F.col("weight") * F.col("num") >= cap * F.col("source_size") * F.col("den"))
    t = t.withColumn("level", F.min(F.when(~F.col("clamped"), F.struct("used", "num", "den"))).over(whole))
    target = F.when(F.col("clamped"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def draw(docs: DataFrame, seed: int) -> Column:
    """The seeded hash of a row: of all its columns that can be hashed."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])


def mix(docs: DataFrame, seed: int = 42, share: tuple[int, int] = (3, 2), cap: int = 2, weights: tuple[int, ...] = WEIGHTS, size: Column | None = None) -> DataFrame:
    """(doc_id, source, _tarn_draw, size, source_size, target, copies) of each row of ``docs``; copies is how often the mix takes it.

    ``copies`` is the whole part of target / source_size, plus one for the rows that a systematic
    sample in seeded hash order picks: those whose running size, at their middle, lies below the
    fractional part of the target. A source is off its target by half a document at most.
    A null source is a source of its own; null and blank texts have size 0 and are never taken; rows that
    are alike in every column are counted one by one, ties in the order go by doc_id and size; further columns only enter the hash;
    an empty table gives an empty result.
    """
    size = n_words(F.col("text")) if size is None else size
    slices = F.greatest(F.lit(MIN_SLICES), F.ceil(F.count(F.lit(1)) / SLICE_ROWS))
    keyed = docs.select("doc_id", "source", size.alias("size"), draw(docs, seed).alias("_tarn_draw"))
    sizes = saved(keyed, "mix-sizes")
    n = sizes.agg(slices.cast("long").alias("n")).first()["n"]
    sizes = sizes.withColumn("_slice", F.pmod(F.col("_tarn_draw"), F.lit(n)))
    # the slices are what is summed first: rows of one source meet in many tasks
    part = sizes.groupBy("source", "_slice").agg(F.sum("size").alias("_in"))
    run = W.partitionBy("source").orderBy("_slice")
    part = part.withColumns({"_before": F.sum("_in").over(run) - F.col("_in")})
    goal = targets(part.groupBy("source").agg(F.sum("_in").alias("source_size")), *share, cap, weights)
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    p, g = part.alias("p"), goal.alias("g")
    offsets = p.join(g, same((F.col("p.source"), F.col("g.source")))).select("p.source", "p._slice", "p._before", "g.source_size", "g.target", "g._whole", "g._left")
    at = W.partitionBy("source", "_slice").orderBy("_tarn_draw", "doc_id", "size")
    sizes = sizes.withColumn("_run", F.sum("size").over(at.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    s, o = sizes.alias("s"), offsets.alias("o")
    both = s.join(o, same((F.col("s.source"), F.col("o.source"))) & (F.col("s._slice") == F.col("o._slice")))
    middle = F.col("o._before") + F.col("s._run") + F.col("s.size") / 2
    extra = F.when((F.col("s.size") > 0) & (middle < F.col("o._left")), 1).otherwise(0)
    copies = F.when(F.col("s.size") > 0, F.col("o._whole") + extra).otherwise(0).cast("int")
    return both.select("s.doc_id", "s.source", "s._tarn_draw", "s.size", "o.source_size", "o.target", copies.alias("copies"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with all its columns.

    Rows that are alike in every column are taken as often as ``mix`` takes them together. Column names that begin with _tarn are
    the operator's own; an empty table gives an empty result.
    """
    cols = docs.columns
    picks = mix(docs, **kw).filter("copies > 0").groupBy(F.col("doc_id").alias("_tarn_id"), F.col("_tarn_draw").alias("_tarn_of"))
    picks = saved(picks.agg(F.sum("copies").alias("_tarn_copies")), "mix-picks")
    draws = docs.withColumn("_tarn_draw", draw(docs, kw.get("seed", 42)))
    alike = saved(draws.groupBy("_tarn_draw").agg(F.count(F.lit(1)).alias("_tarn_rows")).filter("_tarn_rows > 1"), "mix-alike")
    d = draws.join(picks, F.col("doc_id").eqNullSafe(F.col("_tarn_id")) & (F.col("_tarn_draw") == F.col("_tarn_of")))
    repeat = lambda df, n: df.withColumn("_tarn_i", F.explode(F.expr(f"if({n} > 0, sequence(1, cast({n} as int)), cast(array() as array<int>))"))).select(cols)
    if alike.isEmpty():
        return repeat(d, "_tarn_copies")
    # rows that are alike take equal parts of their copies, and one of them what is left
    d = d.join(alike.withColumnRenamed("_tarn_draw", "_tarn_same"), F.col("_tarn_draw") == F.col("_tarn_same"), "left").withColumn("_tarn_rows", F.coalesce("_tarn_rows", F.lit(1)))
    rest = d.filter("_tarn_rows > 1").dropDuplicates(["_tarn_id", "_tarn_draw"])
    return repeat(d, "_tarn_copies div _tarn_rows").unionByName(repeat(rest, "(_tarn_copies % _tarn_rows)"))
