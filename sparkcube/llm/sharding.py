"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by the MD5 of their text (equal texts lie together), then by that of their doc_id; the shards are cuts of this
order. To find a record's place without sorting all records in one task, size-weighted samples give quantile boundaries, the ranges
between them that turn out too large are subdivided, each part is sorted on its own, and exact byte counts of the parts before it give
its base. So the result depends on the order and the sizes alone, not on samples or parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcube.llm._shared import fresh_path, written

#: Expected size-weighted draws, whatever the input; they are reduced to RANGES quantiles.
SAMPLES, RANGES = 20_000, 64
#: A cell, the unit that one task sorts, has at most about this many bytes of text, and a sixteenth of a shard.
CELL_BYTES = 256 << 20
#: A group of equal texts stays in one shard unless it takes more than this share of a shard.
WHOLE_GROUP = 0.05


def _uniform(*columns: Column) -> Column:
    """Reproducible uniform draws in [0, 1) from the columns' hash."""
    return (F.xxhash64(F.lit(7), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def _number(hex_: Column) -> Column:
    """The leading 60 bits of an MD5 as a number; the order of numbers is that of the digests."""
    return F.conv(F.substring(hex_, 1, 15), 16, 10).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32, and the order: key (of the text) and tie (of the doc_id), in one pass over the texts."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"), F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))).alias("tie")
    )


def assign_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, key, tie, cell, shard, slot.

    Records are laid out in the order of key and tie. A record belongs to the shard in whose share of all bytes its middle lies; a group
    of equal texts goes by its own middle, unless it takes more than WHOLE_GROUP of a shard. So shard sizes differ from the mean by at
    most the larger of a record and WHOLE_GROUP of a shard. Null texts count as empty (size 1), null doc_ids as empty names, repeated rows
    each get a slot of their own, an empty table gives no rows, and other columns of the input are ignored. Shuffled are about 90 bytes a
    record; the texts are not.
    """
    rec = written(records(docs).withColumn("at", _number(F.col("key"))), "shard-records")
    whole = rec.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    total = max(1, whole["total"])
    chance = F.col("size") * F.lit(SAMPLES / total)
    # expected SAMPLES draws in all; a record above 1/SAMPLES of all bytes is drawn once per multiple of it
    draws = rec.select("at", (F.floor(chance) + (_uniform("key", "tie") < chance - F.floor(chance)).cast("long")).alias("w")).where("w > 0").select("at", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    marks = draws.agg(F.percentile_approx("at", [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("b")).first()["b"]
    bounds = sorted(set(marks or []))  # a mark that repeats is a key that fills whole ranges
    found = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    below = F.size(F.filter(found, lambda b: b < F.col("at")))
    # ranges alternate: open intervals have even numbers, the marks themselves odd ones
    ranged = rec.withColumn("range", 2 * below + F.array_contains(found, F.col("at")).cast("int"))
    limit = max(1, min(CELL_BYTES, total // (n_shards * 16)))
    sums = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}  # at most 2 * RANGES rows
    parts, first, start, marked = {}, {}, {}, {}
    cell = base = 0
    for r in sorted(sums):
        parts[r], first[r], start[r] = -(-sums[r] // limit), cell, base
        marked[r] = (sums[r] if r % 2 else 0)
        cell, base = cell + parts[r], base + sums[r]
    look = lambda of: F.create_map(*[F.lit(x) for r, n in sorted(of.items()) for x in (r, n)])[F.col("range")].cast("long") if of else F.lit(0).cast("long")
    # a range is subdivided by place, so that parts are in order: intervals by key, marks (one key) by tie
    edges = [0, *bounds, 1 << 60]
    lows, highs = ({r: edges[r // 2 + i] for r in sums} for i in (0, 1))
    by = F.when(F.col("range") % 2 == 1, _number(F.col("tie")) / F.lit(float(1 << 60))).otherwise((F.col("at") - look(lows)) / F.greatest(look(highs) - look(lows), F.lit(1)))
    sub = F.least(F.floor(by * look(parts)), look(parts) - 1).cast("long")
    celled = ranged.withColumn("cell", look(first) + sub)
    cells = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # bytes / limit cells, in 2 * RANGES parts
    cells = cells.select("cell", (look(start) + F.coalesce(F.sum("bytes").over(before), F.lit(0))).alias("base"), look(marked).alias("marked"), look(start).alias("start"))
    placed = celled.drop("range", "at").join(cells, "cell")
    order = ["key", "tie", "size"]
    inside = Window.partitionBy("cell").orderBy(*order)
    group = Window.partitionBy("cell", "key")
    # a mark's group may lie in many cells: its size and start are the range's
    placed = (
        placed.withColumn("own", F.col("base") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("group_bytes", F.when(F.col("marked") > 0, F.col("marked")).otherwise(F.sum("size").over(group)))
        .withColumn("group_start", F.when(F.col("marked") > 0, F.col("start")).otherwise(F.min("own").over(group)))
    )
    keep = F.col("group_bytes") * n_shards <= F.lit(WHOLE_GROUP) * F.lit(float(total))
    # twice the middle, in whole numbers
    at = F.when(keep, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("own") + F.col("size"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(at * F.lit(n_shards) / F.lit(2.0 * total))).cast("int"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "key", "tie", "cell", "shard"), "shard-placed")
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first_slot"))
    rank = Window.partitionBy("shard", "cell").orderBy(*order)
    return (
        placed.join(counts, ["shard", "cell"])
        .withColumn("slot", (F.col("first_slot") + F.row_number().over(rank) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", "key", "tie", "cell", "shard", "slot")
    )


def write_shards(docs: DataFrame, n_shards: int = 16, path: str | None = None) -> str:
    """The documents themselves as Parquet folders shard=0, shard=1, ...; each file covers a run of slots, in order of slot.

    Columns shard and slot of the documents' own are an error, as the folders and the order have these names.
    """
    if clash := [c for c in docs.columns if c.lower() in ("shard", "slot")]:
        raise ValueError(f"the documents have columns {clash}; rename them first")
    path = path or fresh_path(docs.sparkSession, "shards")
    plan = assign_shards(docs, n_shards)
    plan = plan.select("doc_id", "key", "cell", "shard", "slot", F.row_number().over(Window.partitionBy("cell", "doc_id", "key").orderBy("slot")).alias("nth"))
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.md5(text).alias("_key"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0))))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")) & (F.col("_nth") == F.col("nth"))
    out = rows.join(plan, same).select("_row", "shard", "slot", "cell")
    out = out.repartition("shard", "cell").sortWithinPartitions("shard", "slot").select("_row.*", "shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    return path
