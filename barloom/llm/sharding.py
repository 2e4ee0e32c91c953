"""Sharding by sampled splitters.

A sample of keys, drawn with chances in proportion to the records' sizes, gives quantile boundaries; records go to the
ranges between them; ranges that turn out overfull are sampled again and subdivided. Exact totals of the ranges then place
each record on one line of bytes, and shards are equal lengths of that line.

The order is by key, then by a hash of the text, so that a key with many records can be divided; identical records are
counted first and take consecutive places. Defined results: null text has size 1; null keys sort first; an empty table
gives no rows; shards differ from equal sizes by less than the record that lies across their boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import map_rows, session_of, stored, text_or_empty

#: Sampled keys for each range.
SAMPLES = 32


def range_ids(keys: np.ndarray, ties: np.ndarray, key_cuts: np.ndarray, tie_cuts: np.ndarray) -> np.ndarray:
    """Number of splitters (key, tie), sorted, that are not above each (key, tie)."""
    low, high = np.searchsorted(key_cuts, keys, "left"), np.searchsorted(key_cuts, keys, "right")
    out = low.copy()
    for i in np.flatnonzero(low < high):
        out[i] += np.searchsorted(tie_cuts[low[i] : high[i]], ties[i], "right")
    return out


def with_ranges(records: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """records (key, tie, ...) with the column `range`."""
    spark = session_of(records)
    shared = spark.sparkContext.broadcast((np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)))
    names = [c for c in records.columns if c != "range"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema if f.name != "range") + ", range int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "tie"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_ids(keys, ties, *shared.value), pa.int32())], [*names, "range"])

    return map_rows(records.select(*names), run, schema)


def splitters(records: DataFrame, total: int, ranges: int, seed: int) -> list[tuple[int, int]]:
    """Weighted quantiles of a sample of about SAMPLES * ranges keys; the driver holds that many."""
    rate = SAMPLES * ranges / max(total, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "tie"), 11) / F.lit(float(1 << 53))).cast("double")
    weight = F.col("size") * F.col("n") * F.lit(rate)
    drawn = sorted((r["key"], r["tie"], max(1.0, r["w"])) for r in records.withColumn("w", weight).filter(u < F.col("w")).select("key", "tie", "w").collect())
    if not drawn:
        return []
    along = np.cumsum([d[2] for d in drawn])
    at = np.searchsorted(along, along[-1] * np.arange(1, ranges) / ranges)
    return sorted({drawn[i][:2] for i in at.tolist()})


def assign(records: DataFrame, shards: int, seed: int = 11, ranges: int | None = None) -> DataFrame:
    """records (key long, tie long, size long, n long: so many identical records) with shard and slot, one row each."""
    spark = session_of(records)
    whole = records.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("b")).first()
    total = int(whole["b"])
    ranges = ranges or min(4096, max(16 * shards, total >> 28))
    cuts, ranged, totals = splitters(records, total, ranges, seed), None, []
    for attempt in range(3):
        ranged = with_ranges(records, cuts)
        totals = ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("rows"), F.count("*").alias("keys")).collect()  # one row for each range
        over = {r["range"]: r["b"] for r in totals if r["b"] > 2 * total / ranges and r["keys"] > 1}
        if not over or attempt == 2:
            break
        more = splitters(ranged.filter(F.col("range").isin(list(over))), sum(over.values()), max(2, round(2 * ranges * sum(over.values()) / max(total, 1))), seed + 1 + attempt)
        cuts = sorted({*cuts, *more})
    base, bytes_before, rows_before = [], 0, 0
    for r in sorted(totals, key=lambda r: r["range"]):
        base.append((r["range"], bytes_before, rows_before))
        bytes_before += r["b"]
        rows_before += r["rows"]
    offsets = spark.createDataFrame(base, "range int, bytes0 long, rows0 long")
    line = Window.partitionBy("range").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("bytes", F.coalesce(F.sum(F.col("size") * F.col("n")).over(line), F.lit(0)))
        .withColumn("rows", F.coalesce(F.sum("n").over(line), F.lit(0)))
        .join(offsets, "range")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("at", F.col("bytes0") + F.col("bytes") + F.col("copy") * F.col("size"))
        .withColumn("row", F.col("rows0") + F.col("rows") + F.col("copy"))
        .withColumn("shard", F.least(F.floor((F.col("at") + F.col("size") / 2) * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
        .drop("bytes0", "bytes", "rows0", "rows", "range", "copy", "n", "at")
    )
    placed = stored(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("first")).drop("first", "row")  # `first` has one row for each shard


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 11, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs. Only ids, sizes and hashes are moved."""
    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.xxhash64(text).alias("tie"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    counted = stored(rows.groupBy("id", "key", "tie", "size", "crc").agg(F.count("*").alias("n")), "shard-records")
    return assign(counted, shards, seed).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
