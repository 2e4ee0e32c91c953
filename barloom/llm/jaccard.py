"""N-gram Jaccard join by blocked products of the sparse document by n-gram incidence matrix.

A document is a row of the matrix, a hashed five-word shingle a column. The rows of a pair that links have overlaps of at
least a bound that follows from their sizes, so the matrix is multiplied with its transpose in blocks, cheapest first:

1. Head columns. In any one order of columns, two rows that link share a column among the first n - ceil(0.8 n) + 1 of
   each. Rows that share no head column with another text are done: most are.
2. The other rows' whole sets are counted by column. Columns of one row alone can't overlap. In the order by rising
   document frequency, rows whose head holds only such columns are done too: what many documents share comes last.
3. What is left is dealt into blocks by keys that similar rows mostly share. A block's product accumulates exact overlap
   counts over slices of columns; pairs below their bound are discarded, the others' rows are joined up.
4. Every head column is one more block, but for pairs that are connected or that sizes rule out: columns whose rows all
   are are dropped, and those with more rows than a block holds are dealt into sub-blocks of row part by row part.

Step 4 covers every pair that could still link two components, so no link between components is lost; pairs inside one
component need no count. A block sends at most one link for each of its rows. Components are contracted by joins; nothing
about single documents reaches the driver.

Defined results: null or blank text has an empty set, n_shingles 0, and is its own component; fewer words than a shingle
has are one shingle; texts with one set of shingles link; the component of a null id is the smallest id it is linked
with; rows with one id are kept; texts of any length are read whole, and what a task holds is bounded by BLOCK times SLICE
columns or one row; an empty table gives no rows; other columns, whatever their names, are ignored. Shingles and texts are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import byte_table, map_rows, mixed, pieces, prepare, session_of, span_hashes, stored, string_bytes, text_or_empty, words

SHINGLE = 5
#: Least Jaccard similarity of a link, in hundredths.
PERCENT = 80
#: Weight of the rows on one side of a block; a row weighs 1, and 1 more for each SLICE of its columns.
BLOCK = 512
#: Columns in one slice of a block's product.
SLICE = 4096
#: Keys by which rows are first dealt into blocks.
ROUNDS = 2
#: Rows of a small join side that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Postings that a task holds to combine those of one column.
HELD = 1 << 21
#: Postings of one column among those held that make it a candidate for the frequent ones.
OFTEN = 64

_rng = np.random.default_rng(5)
_BYTE = byte_table(_rng)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(1, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the rows of a string column, of those wanted only if that is given."""
    raw, at = string_bytes(column)
    none = np.zeros(0, np.int64)
    for i, j in pieces(at):
        start, end, first = words(part := raw[at[i] : at[j]], at[i : j + 1] - at[i])
        h = span_hashes(part, start, end, _BYTE)
        whole = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            whole += h[k : k + len(whole)] * _PLACE[k]
        whole = mixed(whole).view(np.int64)
        for row in range(i, j):
            if wanted is not None and not wanted[row]:
                continue
            a, b = first[row - i], first[row - i + 1]
            if b - a >= SHINGLE:
                yield row, np.unique(whole[a : b - SHINGLE + 1])
            elif b > a:
                few = (h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[SHINGLE:] * np.uint64(b - a)
                yield row, mixed(few).view(np.int64)
            else:
                yield row, none


def head_size(n):
    """Columns of a row of n of which a linked row shares one at least."""
    return n - (n * PERCENT + 99) // 100 + 1


def spare(n):
    """More columns of a head, so that linked rows share some number of head columns, not one alone."""
    return n // 12


def links(overlap, a, b):
    return overlap * 100 >= PERCENT * (a + b - overlap)


def _fresh(hashes: np.ndarray, seen: set) -> np.ndarray:
    """True at the first row of each text hash in this task."""
    out = np.zeros(len(hashes), bool)
    for i, t in enumerate(hashes.tolist()):
        if t not in seen:
            seen.add(t)
            out[i] = True
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def heads(docs: DataFrame) -> DataFrame:
    """id, t (the text's hash), n (its set's size) and the head columns, of each text once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            fresh, n, head = _fresh(batch.column(1).to_numpy(), seen), [], []
            for row, items in shingle_sets(batch.column(2)):
                n.append(len(items))
                head.append(items[: head_size(len(items)) + spare(len(items))] if fresh[row] and len(items) else none)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int32()), _lists(head)], ["id", "t", "n", "head"])

    return map_rows(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, t long, n int, head array<long>")


def _runs(key: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the length at the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches, HELD rows or more at a time."""
    parts, size = [], 0
    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= HELD:
            yield [np.concatenate(x) for x in zip(*parts)]
            parts, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*parts)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The same, but with all rows of a run of equal values of the first column together."""
    rest = None
    for columns in _held(batches):
        columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
        inner = np.flatnonzero(columns[0] != columns[0][-1])
        cut = inner[-1] + 1 if len(inner) else 0
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None:
        yield rest


def sharing(known: DataFrame) -> DataFrame:
    """The texts t of known (t, n, head) that share as many of their head columns with others as a link needs.

    Of the columns that two linked rows share, the first 1 + spare(n) are in both heads, n being the smaller size, which is
    at least 0.8 times the other. A column that a task finds in two texts is known to be shared: its rows are counted
    there, and one row alone tells the others, so that no frequent column comes together in one task.
    """
    names = ["k", "t", "n", "count"]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column(2)
            at = head.offsets.to_numpy()
            t, n = (np.repeat(batch.column(k).to_numpy(), np.diff(at)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([head.values.slice(at[0], at[-1] - at[0]), pa.array(t), pa.array(n)], ["s", "t", "n"])

    def rows(k, t, n, count) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int32()), pa.array(count, pa.int32())], names)

    def counted(t, n) -> pa.RecordBatch:
        found, where, count = np.unique(t, return_index=True, return_counts=True)
        return rows(found, found, n[where], count)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Single postings (count 0), marks of shared columns (n -1), and counts of a text's columns known to be shared."""
        for s, t, n in _held(unpacked(batches)):
            order = np.argsort(s)
            s, t, n = s[order], t[order], n[order]
            bounds = _runs(s)
            other = np.zeros(len(s), bool)
            other[1:] = (s[1:] == s[:-1]) & (t[1:] != t[:-1])
            shared = np.logical_or.reduceat(other, bounds[:-1])
            many = np.repeat(shared, np.diff(bounds))
            marks = s[bounds[:-1][shared]]
            yield rows(s[~many], t[~many], n[~many], np.zeros((~many).sum(), np.int32))
            yield rows(marks, np.zeros(len(marks), np.int64), np.full(len(marks), -1, np.int32), np.zeros(len(marks), np.int32))
            yield counted(t[many], n[many])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t, n, count in _whole(batches):
            done = count > 0
            yield rows(k[done], t[done], n[done], count[done])
            k, t, n = k[~done], t[~done], n[~done]
            if not len(k):
                continue
            starts = _runs(k)[:-1]
            other = n < 0
            other[1:] |= (k[1:] == k[:-1]) & (t[1:] != t[:-1])
            many = np.repeat(np.logical_or.reduceat(other, starts), np.diff([*starts, len(k)])) & (n >= 0)
            yield counted(t[many], n[many])

    schema = "k long, t long, n int, count int"
    dealt = map_rows(known.select("t", "n", "head").filter("size(head) > 0"), combined, schema).repartition("k").sortWithinPartitions("count", "k", "t")
    total = map_rows(dealt, settled, schema).groupBy("t", "n").agg(F.sum("count").alias("count"))
    smaller = F.floor((F.col("n") * PERCENT + 99) / 100)
    return total.filter(F.col("count") >= 1 + F.floor(smaller / 12)).select("t")


def whole_sets(texts: DataFrame) -> DataFrame:
    """(s, t, n) for every column of each text of texts (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            t = batch.column(0).to_numpy()
            rows, sets = [], []
            for row, items in shingle_sets(batch.column(1), _fresh(t, seen)):
                rows.append(row)
                sets.append(items)
            n = np.array([len(x) for x in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64()), pa.array(np.repeat(t[rows], n) if rows else t[:0], pa.int64()), pa.array(np.repeat(n, n), pa.int32())], ["s", "t", "n"])

    return map_rows(texts, run, "s long, t long, n int")


def frequent_columns(postings: DataFrame, total: int) -> DataFrame:
    """(s): columns that hold one in 200,000 of all postings or more; so there are at most 200,000.

    Counts leave out holdings with less than OFTEN rows of a column, so a column that is spread thin may be missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s,) in _held(batches):
            found, count = np.unique(s, return_counts=True)
            often = count >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(found[often], pa.int64()), pa.array(count[often], pa.int64())], ["s", "count"])

    counts = map_rows(postings.select("s"), run, "s long, count long").groupBy("s").agg(F.sum("count").alias("count"))
    return counts.filter(F.col("count") >= max(4 * OFTEN, -(-total // BROADCAST_ROWS))).select("s")


def shared_columns(postings: DataFrame, frequent: DataFrame) -> DataFrame:
    """(t, n, df, s) of the columns that at least two texts share; df is the number of those.

    The rows of frequent columns are not brought together: their df is the greatest number there is.
    """

    def flush(parts: list, df: int) -> pa.RecordBatch:
        s, t, n = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.int32()), pa.array(np.full(len(s), df, np.int32)), pa.array(s, pa.int64())], ["t", "n", "df", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None  # rows of the open run, how many, its last (s, t)

        def close() -> Iterator[pa.RecordBatch]:
            if size > 1:
                yield flush(held, size)

        for batch in batches:
            often = batch.column(3).to_numpy(zero_copy_only=False)
            s, t, n = (c.to_numpy() for c in batch.columns[:3])
            if often.any():
                yield flush([(s[often], t[often], n[often])], (1 << 31) - 1)
                s, t, n = s[~often], t[~often], n[~often]
            if not len(s):
                continue
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            keep[0] = last != (s[0], t[0])
            open_s, last = last and last[0], (s[-1], t[-1])
            s, t, n = s[keep], t[keep], n[keep]
            if not len(s):
                continue
            bounds = _runs(s)
            a = 0
            if open_s is not None and open_s == s[0]:
                a = bounds[1]
                held.append((s[:a].copy(), t[:a].copy(), n[:a].copy()))
                size += a
            if a < len(s):
                yield from close()
                lengths = np.diff(bounds)
                df = np.repeat(lengths, lengths).astype(np.int32)
                pick = np.flatnonzero(df[a : bounds[-2]] > 1) + a
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(t[pick], pa.int64()), pa.array(n[pick], pa.int32()), pa.array(df[pick], pa.int32()), pa.array(s[pick], pa.int64())], ["t", "n", "df", "s"])
                a = bounds[-2]
                held, size = [(s[a:].copy(), t[a:].copy(), n[a:].copy())], len(s) - a
        yield from close()

    marked = postings.join(F.broadcast(frequent.withColumn("_often", F.lit(True))), "s", "left").select("s", "t", "n", F.coalesce("_often", F.lit(False)).alias("often"))
    return map_rows(marked.repartition(F.when(F.col("often"), F.col("t")).otherwise(F.col("s"))).sortWithinPartitions("often", "s", "t"), run, "t long, n int, df int, s long")


def near_rows(shared: DataFrame) -> DataFrame:
    """t, n, head, items (shared columns, sorted) and keys of the texts whose head by frequency has a shared column.

    A key is the least of the items under a hash, so texts that link have one in common with the probability of their
    similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def close(bounds: np.ndarray, t, n, s) -> pa.RecordBatch:
            out: list = [[], [], [], [], []]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                size, columns = int(n[a]), s[a:b]
                columns = columns[np.concatenate([[True], columns[1:] != columns[:-1]])]  # rows that repeat id and text
                left = head_size(size) - (size - len(columns))  # the columns of this text alone come first in its head
                if left > 0:
                    keys = np.array([mixed(columns.view(np.uint64) * m).min() for m in _PLACE[:ROUNDS]]).view(np.int64)
                    for x, v in zip(out, (t[a], size, columns[:left], np.sort(columns), keys)):
                        x.append(v)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *map(_lists, out[2:])], ["t", "n", "head", "items", "keys"])

        for batch in batches:
            t, n, s = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns))
            if not len(t):
                continue
            bounds = _runs(t)
            yield close(bounds[:-1], t, n, s)
            rest = [x[bounds[-2] :].copy() for x in (t, n, s)]
        if len(rest[0]):
            yield close(np.array([0, len(rest[0])]), *rest)

    return map_rows(shared.repartition("t").sortWithinPartitions("t", "df", "s").select("t", "n", "s"), run, "t long, n int, head array<long>, items array<long>, keys array<long>")


def product(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of every set of one with every set of two: incidence times incidence, over slices of columns."""
    out = np.zeros((len(one), len(two)))
    sides = [one] if one is two else [one, two]
    columns = [np.concatenate([np.zeros(0, np.int64), *sets]) for sets in sides]
    if len(sides) == 2:
        common = np.intersect1d(*columns)
    else:
        common, count = np.unique(columns[0], return_counts=True)
        common = common[count > 1]
        np.fill_diagonal(out, [len(x) for x in one])
    places = []
    for values, sets in zip(columns, sides):
        at = np.searchsorted(common, values)
        hit = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == values) if len(common) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[order], len(sets)))
    for low in range(0, len(common), SLICE):
        parts = []
        for at, row, m in places:
            a, b = np.searchsorted(at, (low, low + SLICE))
            part = np.zeros((m, min(SLICE, len(common) - low)), np.float32)
            part[row[a:b], at[a:b] - low] = 1
            parts.append(part)
        both = parts[0] @ parts[-1].T
        if one is two:
            np.fill_diagonal(both, 0)
        out += both
    return out.astype(np.int64)


def first_linked(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of the component of each row and each column of a matrix of links; len(linked) for columns without."""
    none = len(linked)
    row, column = np.arange(none), np.full(linked.shape[1], none)
    while True:
        new_column = np.where(linked, row[:, None], none).min(0, initial=none)
        new_row = np.minimum(row, np.where(linked, new_column[None, :], none).min(1, initial=none))
        new_row = new_row[new_row]
        if (new_row == row).all() and (new_column == column).all():
            return row, column
        row, column = new_row, new_column


def block_links(blocked: DataFrame) -> DataFrame:
    """(a, b) from the products of blocks (g, part, side, t, n, items): texts with the first of their component in a block.

    Rows of side 0 meet those of side 1; rows of side 2 meet one another. A row has one link at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close() -> Iterator[pa.RecordBatch]:
            sides = [[r for r in held if r[1] == k] for k in range(3)]
            one, two = (sides[2], sides[2]) if sides[2] else sides[:2]
            if not one or not two or len(held) < 2:
                return
            n1, n2 = (np.array([r[3] for r in x], np.int64) for x in (one, two))
            possible = 100 * np.minimum(n1[:, None], n2[None, :]) >= PERCENT * np.maximum(n1[:, None], n2[None, :])
            if not possible.any():
                return
            sets = [r[4] for r in one]
            linked = possible & links(product(sets, sets if one is two else [r[4] for r in two]), n1[:, None], n2[None, :])
            t1, t2 = (np.array([r[2] for r in x], np.int64) for x in (one, two))
            row, column = first_linked(linked)
            pairs = [(t1[i], t1[row[i]]) for i in np.flatnonzero(row != np.arange(len(row)))]
            if one is not two:
                pairs += [(t2[i], t1[column[i]]) for i in np.flatnonzero(column < len(row))]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            values, offsets = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
            g, part, side, t, n = (batch.column(k).to_pylist() for k in range(5))
            for i in range(batch.num_rows):
                if held and held[0][0] != (g[i], part[i]):
                    yield from close()
                    held = []
                held.append(((g[i], part[i]), side[i], t[i], n[i], values[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield from close()

    rows = blocked.select("g", "part", "side", "t", "n", "items").repartition("g", "part").sortWithinPartitions("g", "part")
    return map_rows(rows, run, "a long, b long")


def _weight(items: str = "items"):
    return (F.lit(1) + F.floor(F.size(items) / SLICE)).cast("long")


def _dealt(near: DataFrame, labels: DataFrame, number: int) -> DataFrame:
    """(t, g, part, side): the first text of each label with one key, in parts of about BLOCK weight dealt by hash."""
    rows = near.select("t", _weight().alias("weight"), F.col("keys")[number].alias("g")).join(labels, "t", "left")
    first = rows.groupBy("g", F.coalesce("label", "t").alias("label")).agg(F.min(F.struct("t", "weight")).alias("first")).select("g", "first.*")
    parts = first.groupBy("g").agg(F.ceil(F.sum("weight") / F.lit(float(BLOCK))).cast("int").alias("parts"), F.count("*").alias("size")).filter("size > 1").drop("size")
    return first.join(parts, "g").select("t", "g", F.pmod(F.xxhash64(F.lit(number), "t"), F.col("parts")).alias("part"), F.lit(2).alias("side"))


def contract(edges: DataFrame) -> DataFrame:
    """(t, label): every end of edges (a, b) with its component's label. Each round maps a text to its least neighbour."""
    maps: list[DataFrame] = []
    while True:
        both = edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select("b", "a")).distinct()
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "jaccard-least")
        maps.append(least)
        one, two = least.select(F.col("a"), F.col("m").alias("ma")), least.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        edges = stored(edges.join(one, "a").join(two, "b").filter("ma != mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct(), "jaccard-edges")
        if edges.isEmpty():
            break
    out = maps[0].select(F.col("a").alias("t"), F.col("m").alias("label"))
    for m in maps[1:]:
        out = out.join(m.withColumnRenamed("a", "label"), "label", "left").select("t", F.coalesce("m", "label").alias("label"))
    return stored(out, "jaccard-labels")


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("t").alias("a"), F.col("label").alias("b"))


#: Bits of a row's class in a block: pairs whose classes share a bit need no product.
MAIN, OWN, SMALLER = 4, 2, 1


def _class_sums():
    return [F.sum(F.when(F.col("bits") == c, F.col("weight")).otherwise(0)).alias(f"c{c}") for c in range(4)]


def _with_main(by_label: DataFrame, *keys: str) -> DataFrame:
    """Of each block: sums over its labels, the most frequent label `main`, and the parts of its eight classes."""
    most = F.max(F.struct("size", "label", "c0", "c1", "c2", "c3")).alias("m")
    more = [f(c).alias(c) for f, c in ((F.min, "met0"), (F.max, "met1"), (F.bit_xor, "x0"), (F.bit_xor, "x1"), (F.sum, "blocks")) if c in by_label.columns]
    out = by_label.groupBy(*keys).agg(F.sum("size").alias("size"), F.count("*").alias("labels"), *more, *(F.sum(f"c{c}").alias(f"c{c}") for c in range(4)), most)
    parts = [F.ceil((F.col(f"c{c}") - F.col(f"m.c{c}")) / F.lit(float(BLOCK))).cast("int") for c in range(4)] + [F.ceil(F.col(f"m.c{c}") / F.lit(float(BLOCK))).cast("int") for c in range(4)]
    return out.withColumns({"main": F.col("m.label"), "small": F.expr(f"c0 + c1 + c2 + c3 <= {BLOCK}"), "parts": F.array(*parts)}).drop("m")


def _placed(rows: DataFrame) -> DataFrame:
    """(t, g, part, side) of rows (t, g, c, small, parts): a small block whole, others by part and part of classes that meet."""
    whole = rows.filter("small").select("t", "g", F.lit(-1).cast("bigint").alias("part"), F.lit(2).alias("side"))
    others = "flatten(transform(sequence(0, 7), d -> if((c & d) = 0 and parts[d] > 0, transform(sequence(0, parts[d] - 1), q -> q * 8 + d), array())))"
    placed = rows.filter("not small").withColumn("own", F.pmod(F.xxhash64("t"), F.expr("parts[c]")) * 8 + F.col("c")).withColumn("other", F.explode(F.expr(others)))
    pair = F.xxhash64(F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    return whole.union(placed.select("t", "g", pair.alias("part"), side.alias("side")))


def _class(label: str = "label"):
    return (F.col("bits") + F.when(F.col(label) == F.col("main"), MAIN).otherwise(0)).alias("c")


def remaining(near: DataFrame, labels: DataFrame, dealt: DataFrame) -> DataFrame:
    """(t, g, part, side): sub-blocks that cover every pair that shares a head column, may link and is not connected.

    `dealt` are blocks in which all rows have met already. A block is a head column and a band of sizes, the band's own rows
    and, as smaller ones, those of the band below. Three kinds of pairs in it need no product: those of the most frequent
    label; those of smaller rows, which meet in the band below; and those where both rows have more columns that no other
    text has than a link leaves room for (a link of overlap I needs 5 I >= 4 U, and U is at least I plus the own columns of
    both). Blocks where no pair is left, and those with the same rows as another, are dropped.

    The texts that columns join, however far, are a family. A family whose parts are fewer than the blocks that its texts
    are in is one block in place of those, so that each text is sent less often. Small blocks are multiplied whole; in
    larger ones the rows of each class are dealt into parts, and a sub-block is a part by a part of a class that shares no
    bit with the first's.
    """
    band = F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))
    own = F.col("n") - F.size("items")
    rows = near.select("t", "n", _weight().alias("weight"), F.explode("head").alias("s"), (2 * PERCENT * own > (100 - PERCENT) * F.size("items")).alias("own"), band.alias("band"))
    met = dealt.select("t", F.xxhash64("g", "part").alias("met"))
    rows = rows.join(labels, "t", "left").join(met, "t", "left").withColumns({"label": F.coalesce("label", "t"), "met": F.coalesce("met", "t")})
    rows = rows.withColumn("k", F.explode(F.sequence(F.floor(F.col("band") - 1e-9), F.floor(F.col("band") + 1 + 1e-9))))
    bits = F.when(F.col("own"), OWN).otherwise(0) + F.when(F.col("k") > F.floor("band"), SMALLER).otherwise(0)
    rows = rows.select("s", "k", "t", "label", "met", "weight", bits.alias("bits"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "t", "bits")).alias(f"x{i}") for i in range(2)]
    by_label = rows.groupBy("s", "k", "label").agg(F.count("*").alias("size"), F.min("met").alias("met0"), F.max("met").alias("met1"), *marks, *_class_sums())
    blocks = _with_main(by_label, "s", "k").filter("labels > 1 and met0 < met1 and c0 + c1 > 0 and c0 + c2 > 0")
    blocks = blocks.groupBy("size", "x0", "x1").agg(F.min(F.struct("s", "k", "main", "small", "parts")).alias("b")).select("b.*")
    blocks = stored(blocks, "jaccard-blocks")
    few = blocks.count() <= BROADCAST_ROWS
    rows = stored(rows.drop("met").join(F.broadcast(blocks) if few else blocks, ["s", "k"]), "jaccard-rows")
    first = rows.groupBy("s", "k").agg(F.min("t").alias("b"))
    family = contract(rows.join(F.broadcast(first) if few else first, ["s", "k"]).select(F.col("t").alias("a"), "b").distinct()).withColumnRenamed("label", "family")
    texts = rows.groupBy("t").agg(F.first("label").alias("label"), F.first("weight").alias("weight"), F.min(F.col("bits").bitwiseAND(OWN)).alias("bits"), F.count("*").alias("blocks")).join(family, "t")
    families = _with_main(texts.groupBy("family", "label").agg(F.count("*").alias("size"), F.sum("blocks").alias("blocks"), *_class_sums()), "family")
    families = families.filter(F.col("small") | (F.aggregate("parts", F.lit(0), lambda a, x: a + x) * F.col("size") <= F.col("blocks"))).select("family", "main", "small", "parts")
    together = stored(texts.join(families, "family").select("t", F.xxhash64("family").alias("g"), _class(), "small", "parts"), "jaccard-families")
    apart = rows.join(together.select("t"), "t", "left_anti").select("t", F.xxhash64("s", "k").alias("g"), _class(), "small", "parts")
    return _placed(together).union(_placed(apart))


def _products(near: DataFrame, dealt: DataFrame) -> DataFrame:
    return block_links(near.select("t", "n", "items").join(dealt, "t"))


def labelled(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(id, t, n) of each row of docs, and (t, label, least id) of each text that has a shingle."""
    spark = session_of(docs)
    prepare(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_or_empty(text_column)).alias("t"), text_or_empty(text_column).alias("text"))
    known = stored(heads(rows), "jaccard-heads", "snappy")
    # One row of each text goes on, whichever partitions its copies are in.
    chosen = known.groupBy("t").agg(F.min("id").alias("_id"), F.max("n").alias("_n")).join(sharing(known), "t").withColumnRenamed("t", "_t")
    chosen = stored(chosen, "jaccard-sharing")
    count, total = chosen.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    again = rows.join(F.broadcast(chosen) if count <= BROADCAST_ROWS else chosen, (F.col("t") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("t", "text")
    postings = whole_sets(again)
    frequent = stored(frequent_columns(postings, total), "jaccard-frequent")
    near = stored(near_rows(shared_columns(postings, frequent)), "jaccard-near", "snappy")
    labels = spark.createDataFrame([], "t long, label long")
    dealt = first = stored(_dealt(near, labels, 0), "jaccard-dealt")
    found = stored(_products(near, dealt), "jaccard-links")  # a text is in one block, so these are components as they are
    labels = found.toDF("t", "label")
    for number in range(1, ROUNDS):
        dealt = stored(_dealt(near, labels, number), "jaccard-dealt")
        labels = contract(_edges(labels).union(_products(near, dealt)))
    late = stored(_products(near, remaining(near, labels, first)), "jaccard-late")
    if not late.isEmpty():
        labels = contract(_edges(labels).union(late))
    known = known.select("id", "t", "n")
    least = known.filter("n > 0").groupBy("t").agg(F.min("id").alias("least"))  # one row for each text
    return known, least.join(labels, "t", "left").select("t", F.coalesce("label", "t").alias("label"), "least")


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles and component_id of each row of docs."""
    known, texts = labelled(docs, id_column, text_column)
    whole = texts.groupBy("label").agg(F.min("least").alias("component"))
    by_text = texts.select("t", "label").join(whole, "label").select("t", "component")
    out = known.join(by_text, "t", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs but for near copies: of a component the row of the least id (null last), then text hash, stays.

    Of rows that repeat id and text one stays, that of the least hash of all columns. Documents without words stay. Texts
    are not moved unless more than BROADCAST_ROWS rows go.
    """
    known, texts = labelled(docs, id_column, text_column)
    rows = stored(known.groupBy("id", "t").agg(F.count("*").alias("copies")).join(texts.select("t", "label"), "t", "left"), "jaccard-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    best = rows.filter("label is not null").groupBy("label").agg(first, F.count("*").alias("members")).filter("members > 1").select("label", "first.id", "first.t")
    best = stored(best.toDF("label", "best", "best_t"), "jaccard-best")
    met = rows.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "label", "left")
    goes = F.col("best_t").isNotNull() & ~(F.col("id").eqNullSafe(F.col("best")) & (F.col("t") == F.col("best_t")))
    gone = stored(met.filter(goes | (F.col("copies") > 1)).select("id", "t", (~goes).alias("repeated")), "jaccard-gone")
    few = gone.count() <= BROADCAST_ROWS
    plain = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of docs can clash
    place = lambda c: plain[docs.columns.index(c)]
    own = docs.toDF(*plain).withColumn("own", F.xxhash64(text_or_empty(place(text_column))))
    same = (F.col("own") == F.col("t")) & F.col(place(id_column)).eqNullSafe(F.col("id"))
    single = own.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*plain)
    again = gone.filter("repeated")
    nth = F.row_number().over(Window.partitionBy(place(id_column), "own").orderBy(F.xxhash64(*plain)))
    repeated = own.join(F.broadcast(again) if few else again, same, "left_semi").withColumn("nth", nth).filter("nth = 1").select(*plain)
    return single.union(repeated).toDF(*docs.columns)
