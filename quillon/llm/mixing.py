"""Mixing sources to target token weights by entropy balancing, in DataFrame functions only.

Rates r of documents minimise the sum of r ln r - r + 1 (the divergence from one copy each) under
one constraint a source: the sum of r times size is the source's target, and 0 <= r <= ``limit``.
The dual is convex with one multiplier a source, and the optimum is exponentially tilted:
r = min(limit, exp(lambda_source * size / mean_source)). Newton steps, kept inside a bracket, run
over the counts of documents for each source and size: the text is read once, each step
aggregates a small table. Rates are rounded into copies level by level of size from long to short
documents, each level taking over what the longer ones missed, so short documents settle the rest.
In each level the documents of lowest draw (a hash) get one copy more. The draw up to which that goes is
found from counts of hash buckets, their prefix sums and the ranks in a single bucket, so no source,
however large, meets in one task, and texts stay where they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._work import discard, free_name, stash

# Weights of the sources in order of code point, again and again.
WEIGHTS = (5, 2, 1)
LIMIT = 3

#: Levels of size in each doubling; buckets by which ranks in a level are split; steps of Newton at most,
#: and steps between two tables that are written.
LEVELS, BUCKETS, STEPS, TOGETHER = 32, 1024, 60, 4


def word_count(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, mean, target, from rows of (source, size, n).

    All sizes together are shared by weight; a target stops at ``limit`` times its source's size, and
    what is over is shared anew by weight among the others, until none is above: with sources in order
    of limit by weight, those before some place stop, and the rest get one common amount a weight.
    The table has a row for each source, so its windows are over few rows.
    """
    total = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    place = (F.row_number().over(total) - 1) % len(weights)
    weighted = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("most", F.col("source_size") * float(limit))
    ratio = F.col("most") / F.col("weight")
    whole = Window.partitionBy()
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source in that order that its share leaves below its limit, and with it all later ones.
    first = F.min(F.when(F.col("share") <= ratio, F.struct("order", "share"))).over(whole)
    levels = weighted.withColumns({"share": share, "order": F.row_number().over(Window.orderBy(ratio, F.col("source").asc_nulls_last()))}).withColumn("level", first["share"])
    target = F.when(F.col("level").isNull() | (ratio < F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"), target.alias("target"))


def _rate(limit: int, row: Column | None = None) -> Column:
    """Copies of a document by its size and its source's multiplier, of columns or of the fields of ``row``."""
    of = F.col if row is None else row.getField
    tilt = F.least(of("lam") * of("size") / of("mean"), F.lit(math.log(limit)))
    return F.when(of("size") == 0, F.lit(1.0)).when(of("full"), float(limit)).otherwise(F.exp(tilt))


def solve(sizes: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``targets`` with the multiplier ``lam`` and ``full`` (the target is all that the limit allows)."""
    full = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    state = stash(targets.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "full": full, "off": F.lit(1.0)}), "dual")
    for _ in range(STEPS // TOGETHER):
        moved = state
        for _ in range(TOGETHER):
            moved = _newton(moved, sizes, limit)
        last, state = state, stash(moved, "dual")
        discard(last)
        if (state.agg(F.max("off")).first()[0] or 0.0) < 1e-9:
            break
    return state


def _newton(state: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """One step of every source's multiplier; halves the bracket where Newton's step would leave it."""
    z = F.col("size") / F.col("mean")
    joined = sizes.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
    words = F.col("n") * F.col("size") * _rate(limit)
    tilted = F.col("lam") * z < math.log(limit)
    sums = joined.groupBy("s").agg(F.sum(words).alias("got"), F.sum(F.when(tilted, words * z).otherwise(0.0)).alias("slope"))
    miss = F.col("got") - F.col("target")
    moved = state.join(sums, F.col("s").eqNullSafe(F.col("source"))).withColumns({"low": F.when(miss < 0, F.greatest("low", "lam")).otherwise(F.col("low")), "high": F.when(miss > 0, F.least("high", "lam")).otherwise(F.col("high"))})
    step = F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope"))
    inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
    lam = F.when(F.abs(miss) <= F.col("target") * 1e-12, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
    off = F.when(F.col("full") | (F.col("target") == 0), F.lit(0.0)).otherwise(F.abs(miss) / F.col("target"))
    return moved.withColumns({"lam": lam, "off": off}).select(*state.columns)


def _level(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * LEVELS)).otherwise(-1).cast("int")


def _draw(doc_id: Column, size: Column) -> Column:
    """A document's lot: the same whatever rows are with it."""
    return F.xxhash64(doc_id, size, F.lit(8))


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row a source: source, source_size, target, what a rate needs, and ``cuts``: levels with the highest draw that adds a copy.

    ``sized``: doc_id, source, size, of a written table. A source has at most LEVELS levels for each doubling of size.
    """
    sizes = stash(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    dual = solve(sizes, source_targets(sizes, weights, limit), limit)
    rates = sizes.withColumnRenamed("source", "s").join(dual, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("rate", _rate(limit))
    steps = rates.withColumns({"least": _least(limit), "level": _level(F.col("size"))})
    room = F.when((F.col("least") < limit) & (F.col("size") > 0), F.col("n")).otherwise(0)
    by_level = steps.groupBy("source", "level").agg(
        F.sum(F.col("n") * F.col("size") * (F.col("rate") - F.col("least"))).alias("more"), F.sum(room).alias("room"), F.sum(room * F.col("size")).alias("room_words")
    )
    item = F.struct((-F.col("level")).alias("order"), "more", "room", "room_words")
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<level:int,extra:bigint,room:bigint>>").alias("done"))

    def settle(acc: Column, x: Column) -> Column:
        due = acc["carry"] + x["more"]
        mean = x["room_words"] / F.when(x["room"] > 0, x["room"])
        extra = F.coalesce(F.greatest(F.lit(0), F.least(x["room"], F.round(due / mean).cast("long"))), F.lit(0).cast("long"))
        one = F.struct((-x["order"]).alias("level"), extra.alias("extra"), x["room"].cast("long").alias("room"))
        return F.struct((due - extra * F.coalesce(mean, F.lit(0.0))).alias("carry"), F.concat(acc["done"], F.array(one)).alias("done"))

    quota = by_level.groupBy("source").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, settle)["done"].alias("done")).select("source", F.inline("done"))
    quota = stash(quota.filter((F.col("extra") > 0)), "quota")

    # The draw of each level's last extra copy: the bucket of draws that it lies in first, then its place in that.
    named = dual.select(F.col("source").alias("s"), "lam", "mean", "full")
    lots = sized.join(named, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    lots = lots.withColumns({"least": _least(limit), "level": _level(F.col("size")), "draw": _draw(F.col("doc_id"), F.col("size"))})
    lots = lots.filter((F.col("least") < limit) & (F.col("size") > 0)).select("source", "level", "draw", F.shiftright("draw", 64 - BUCKETS.bit_length() + 1).alias("bucket"))
    buckets = lots.groupBy("source", "level", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    sofar = F.sum("rows").over(Window.partitionBy("source", "level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select(F.col("source").alias("s"), F.col("level").alias("l"), F.col("bucket").alias("b"), "rows", F.coalesce(sofar, F.lit(0)).alias("start"))
    at = (F.col("s").eqNullSafe(F.col("source"))) & (F.col("l") == F.col("level"))
    last = starts.join(quota, at).filter((F.col("extra") > F.col("start")) & (F.col("extra") <= F.col("start") + F.col("rows"))).select("s", "l", "b", (F.col("extra") - F.col("start")).alias("place"))
    inside = lots.join(last, at & (F.col("b") == F.col("bucket")))
    rank = F.row_number().over(Window.partitionBy("source", "level").orderBy("draw"))
    cuts = inside.withColumn("rank", rank).filter(F.col("rank") == F.col("place")).select("source", F.col("level"), "draw")
    by_source = cuts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("level", "draw"))).alias("cuts")).withColumnRenamed("source", "s")
    return stash(dual.join(by_source, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "mean", "lam", "full", "cuts"), "plan")


def _least(limit: int) -> Column:
    return F.least(F.floor(_rate(limit)), F.lit(limit)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``limit``), so that copies times size meet the targets.

    ``docs`` needs doc_id, source and, unless ``size`` is given, text (null: size 0). A null source is a
    source of its own. Documents of size 0 keep one copy, which counts nothing. Reruns over the same rows
    agree; rows of the same doc_id and size share their lot, so they are taken or left together. A null
    doc_id counts as a value. An empty table gives an empty table. Columns of these four names that ``docs``
    has already are replaced; others are free. Texts of any length are counted whole.

    Texts are never shuffled: sizes are counted into a narrow table, which gives each source its rate and its
    cuts; then every row is decided where it lies.
    """
    added = ("size", "source_size", "target", "copies")
    size = (word_count(F.col("text")) if size is None else size).cast("long")
    sized = stash(docs.select(F.col("doc_id"), F.col("source"), size.alias("size")), "sized")
    own = source_plan(sized, weights, limit).select(F.struct(F.col("source").alias("source"), "source_size", "target", "mean", "lam", "full", "cuts").alias("plan"))
    kept = [c for c in docs.columns if c.lower() not in added]
    plan, z, row = (free_name(docs.columns, n) for n in ("plan", "size", "row"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias(z))
    rows = rows.join(own.withColumnRenamed("plan", plan), F.col("source").eqNullSafe(F.col(plan)["source"]))
    inner = F.struct(F.col(z).alias("size"), F.col(plan)["mean"].alias("mean"), F.col(plan)["lam"].alias("lam"), F.col(plan)["full"].alias("full"))
    rows = rows.withColumn(row, inner)
    least = F.least(F.floor(_rate(limit, F.col(row))), F.lit(limit)).cast("long")
    cut = F.try_element_at(F.col(plan)["cuts"], _level(F.col(z)))
    more = F.coalesce((_draw(F.col("doc_id"), F.col(z)) <= cut) & (F.col(z) > 0) & (least < limit), F.lit(False)).cast("long")
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(z).alias("size"), F.col(plan)["source_size"].alias("source_size"), F.col(plan)["target"].alias("target"), (least + more).alias("copies"))
