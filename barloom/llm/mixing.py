"""Mixing sources to target weights by fitting a budget of words exactly.

Whole passes over a source come first; what is left of its target is a budget below one pass. The source's documents are
counted by exact length, and the budget is filled from those counts: a bounded-knapsack dynamic program over its last
words, and each length's share before those. Which documents of a length are taken is decided by a seeded hash.

Defined results: null text has size 0; texts of any length are counted whole; sources are ordered by code point, null
last; a row is never taken more than `most` times; of rows that repeat id and text (ties of the hash) as many are taken as
fit the budget; an empty table gives no rows; mixed_documents() keeps other columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import map_rows, pieces, session_of, stored, string_bytes, text_or_empty, words

#: Words that are left to the dynamic program at first; sixteen times more whenever it does not fill them all.
EXACT = 1 << 16
#: Rows of a small join side that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def water_level(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to weights that sum to total; one stops at most * size, and the others share the excess."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] >= most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = level * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            free.discard(i)
        left = max(left, 0.0)
    return targets


def _shares(lengths: list[int], counts: list[int], budget: int, left: int) -> list[int]:
    """A share of each length that is proportional to its count, with about `left` words of the budget to spare."""
    total = sum(length * n for length, n in zip(lengths, counts))
    aim = max(0, budget - left)
    take = [n * aim // total for n in counts]
    spare = budget - sum(length * k for length, k in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * aim % total), lengths[i])):  # the largest remainders first
        if aim and take[i] < counts[i] and spare - lengths[i] >= left:
            take[i] += 1
            spare -= lengths[i]
    return take


def _knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take for the greatest sum up to budget; each count is split into powers of two."""
    by = np.full(budget + 1, -1, np.int32)  # the step that first reached each sum
    by[0] = 0
    steps = [(0, 0)]
    for i in sorted(range(len(lengths)), key=lambda i: -min(counts[i], budget // lengths[i]) if lengths[i] else 1):
        spare, chunk = min(counts[i], budget // lengths[i]) if lengths[i] else 0, 1
        while spare and by[budget] < 0:
            chunk = min(chunk, spare)
            far = lengths[i] * chunk
            new = np.flatnonzero((by[far:] < 0) & (by[: len(by) - far] >= 0)) + far
            by[new] = len(steps)
            steps.append((i, chunk))
            spare -= chunk
            chunk *= 2
    take = [0] * len(lengths)
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, chunk = steps[by[at]]
        take[i] += chunk
        at -= lengths[i] * chunk
    return take


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near to budget, from below, as the lengths allow.

    A sum that equals the budget is best. While there is none, the dynamic program gets more of the budget, at last all.
    """
    total = sum(length * n for length, n in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    unit = math.gcd(*lengths)
    lengths, budget, left = [x // unit for x in lengths], max(budget, 0) // unit, EXACT
    while True:
        take = _shares(lengths, counts, budget, left)
        spare = budget - sum(length * k for length, k in zip(lengths, take))
        more = _knapsack(lengths, [n - k for n, k in zip(counts, take)], spare)
        if left >= budget or sum(length * k for length, k in zip(lengths, more)) == spare:
            return [k + m for k, m in zip(take, more)]
        left *= 16


def sizes(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """id, source, h (a seeded hash of id and text) and size (words) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_bytes(batch.column(3))
            n = [np.zeros(0, np.int64)]
            for i, j in pieces(at):
                n.append(np.diff(words(raw[at[i] : at[j]], at[i : j + 1] - at[i])[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(n), pa.int64())], ["id", "source", "h", "size"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), row_hash(seed, id_column, text_column).alias("h"), text_or_empty(text_column).alias("text"))
    return map_rows(picked, run, f"id {kind}, source string, h long, size long")


def row_hash(seed: int, id_column: str, text_column: str):
    return F.xxhash64(F.lit(seed), F.col(id_column), text_or_empty(text_column))


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Of each source: its size, target and whole passes; of each (source, size): the hash and id up to which one more is
    taken, and of how many of the rows that repeat those.

    The driver sees one row for each source. Documents are only counted there, by exact length, before anything moves.
    """
    spark = session_of(rows)
    found = sorted(((r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sized = [s for _, s in found]
    targets = water_level(sized, [weights[i % len(weights)] for i in range(len(sized))], share * sum(sized), most)
    passes = [min(most, int(t // s)) if s else 0 for s, t in zip(sized, targets)]
    sources = spark.createDataFrame(
        [(name, s, t, p, max(0, round(t - p * s)) if p < most else 0) for (name, s), t, p in zip(found, targets, passes)],
        "source string, source_size long, target double, passes int, budget long",
    )
    # Cells of one length are cut finer by the hash's high bits, so that no cell holds more than a small part of the rows.
    cell = rows.withColumn("sub", F.shiftright("h", 54)).groupBy("source", "size", "sub").agg(F.sum("n").alias("n"))
    lengths = cell.groupBy("source", "size").agg(F.sum("n").alias("n")).join(sources.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s"))).filter("budget > 0 and size > 0").drop("s")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        frame["take"] = fit_budget(frame["size"].tolist(), frame["n"].tolist(), int(frame["budget"].iloc[0]))
        return frame[["source", "size", "take"]]

    # One row for each distinct length: a group is bounded by the longest document, not by the number of documents.
    quota = lengths.groupBy("source").applyInPandas(fit, "source string, size long, take long").filter("take > 0")
    per_length = Window.partitionBy("source", "size").orderBy("sub")
    cut = (
        cell.join(quota.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .withColumn("upto", F.sum("n").over(per_length.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("upto >= take and upto - n < take")
        .select("s", "z", F.col("sub").alias("b"), (F.col("take") - F.col("upto") + F.col("n")).alias("nth"))
    )
    cut = stored(cut, "mix-cut")
    few = cut.count() <= BROADCAST_ROWS
    in_cell = Window.partitionBy("source", "size", "sub").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        rows.withColumn("sub", F.shiftright("h", 54))
        .join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("b")))
        .withColumn("upto", F.sum("n").over(in_cell))
        .filter("upto >= nth and upto - n < nth")
        .select("s", "z", F.col("h").alias("cut"), F.col("id").alias("cut_id"), (F.col("nth") - F.col("upto") + F.col("n")).alias("part"))
    )
    return sources, F.broadcast(cuts) if few else cuts


def taken(rows: DataFrame, sources: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (id, source, size, h, n) with source_size, target, passes, and more: how many of the n are taken once more."""
    with_source = rows.join(F.broadcast(sources.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))  # one row for each source, as on the driver
    with_cut = with_source.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    last = (F.col("h") == F.col("cut")) & F.col("id").eqNullSafe(F.col("cut_id"))
    # Rows of one hash and several ids are in order of their ids, null first, as the window had them.
    before = (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & F.col("cut_id").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("cut_id")))
    more = F.when(last, F.col("part")).when(before, F.col("n")).otherwise(0).cast("long")
    return with_cut.select("id", "source", "size", "h", "n", "source_size", "target", "passes", more.alias("more"))


def _rows(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """sizes() with n: one row for those that repeat id, text and source."""
    return stored(sizes(docs, seed, id_column, text_column, source_column).groupBy("id", "source", "h", "size").agg(F.count("*").alias("n")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Of each row of docs: id, size, source_size, target and taken (size times the copies that the mix takes)."""
    rows = _rows(docs, seed, id_column, text_column, source_column)
    sources, cuts = plan(rows, weights, share, most)
    each = taken(rows, sources, cuts).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("passes") + (F.col("k") <= F.col("more")).cast("int")
    return each.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it, and the same columns."""
    rows = _rows(docs, seed, "doc_id", "text", "source")
    sources, cuts = plan(rows, weights, share, most)
    copies = stored(taken(rows, sources, cuts).select("id", "h", "source", "n", "passes", "more").filter("passes + more > 0"), "mix-copies")
    plain = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of docs can clash
    own = docs.toDF(*plain).select(*plain, row_hash(seed, plain[docs.columns.index("doc_id")], plain[docs.columns.index("text")]).alias("own"))
    place = {c: plain[docs.columns.index(c)] for c in ("doc_id", "source")}
    same = (F.col("own") == F.col("h")) & F.col(place["doc_id"]).eqNullSafe(F.col("id")) & F.col(place["source"]).cast("string").eqNullSafe(F.col("source"))
    whole = own.join(copies.filter("more = 0 or more = n").withColumn("times", F.col("passes") + F.when(F.col("more") > 0, 1).otherwise(0)), same).select(*plain, "times")
    # Rows that repeat id and text, of which some are taken once more: one such group for each source and size at most.
    some = own.join(copies.filter("more > 0 and more < n"), same)
    nth = F.row_number().over(Window.partitionBy("h", "id", "source").orderBy("own"))
    some = some.select(*plain, (F.col("passes") + F.when(nth <= F.col("more"), 1).otherwise(0)).alias("times"))
    every = whole.union(some).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return every.select(*plain).toDF(*docs.columns)
