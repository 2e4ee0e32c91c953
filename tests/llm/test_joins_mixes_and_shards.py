from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from barloom.llm import jaccard, mixing, sharding
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """n_shingles and component_id of (id, text) rows by comparing every two sets."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    least = defaultdict(list)
    for (d, _), k in zip(rows, label):
        least[k].append(d)
    return sorted((d, len(s), min(least[k])) for (d, _), s, k in zip(rows, sets, label))


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"t": F.lit("clash"), "n": F.lit(0)})
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(frame).collect())
    assert got == brute(rows)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(400))
    rows, shared = [], " ".join(word() for _ in range(60))
    for i in range(12):
        w = [word() for _ in range(int(rng.integers(1, 120)))]
        rows.append(" ".join(w))
        for k in range(int(rng.integers(0, 5))):
            v = list(w)
            for _ in range(k):
                v[int(rng.integers(len(v)))] = word()
            rows.append(" ".join(v).upper() if k == 1 else "\n".join(v))
        rows.append(shared + " " + " ".join(word() for _ in range(40)))
    rows += [None, "", "  \n", "One two", "one TWO", "one two three", "É a b c d", "é a b c d", "x " * 9000]
    check(spark, list(enumerate(rows)) + [(3, rows[3])])


def test_large_group_of_near_copies_in_parts(spark, monkeypatch):
    """Blocks smaller than the group: parts, outlying texts and late pairs all have work."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(5)
    root = [f"r{i}" for i in range(60)]
    rows = []
    for i in range(60):
        v = list(root)
        for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            v[p] = f"n{rng.integers(5)}"
        rows.append((i, " ".join(v + [f"t{k}" for k in range(int(rng.integers(0, 12)))])))
    check(spark, rows)


def test_one_link_across_parts_of_form_letters(spark, monkeypatch):
    """Form letters below the bound, in one divided block, and a single near copy that is dealt to another part."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    letters = [" ".join([f"f{k}" for k in range(89)] + [f"own{i}x{k}" for k in range(15)]) for i in range(40)]
    copies = [letters[7] + f"y{k}" for k in range(20)]  # another last word
    parts = -(-(len(letters) + 1) // jaccard.BLOCK)
    dealt = spark.createDataFrame(list(enumerate([letters[7], *copies])), "i int, text string").select("i", F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(parts)).alias("part"))
    part = [r["part"] for r in sorted(dealt.collect())]
    copy = next(c for c, p in zip(copies, part[1:]) if p != part[0])
    check(spark, list(enumerate([*letters, copy])))


def test_empty_table_of_documents(spark):
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
def test_budget_is_filled_as_well_as_can_be(counts, budget):
    lengths = sorted(counts)
    many = [counts[x] for x in lengths]
    take = mixing.fit_budget(lengths, many, budget)
    assert all(0 <= k <= n for k, n in zip(take, many))
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    assert sum(x * k for x, k in zip(lengths, take)) == max(s for s in sums if s <= budget)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=8), st.integers(0, 3000))
def test_budget_beyond_what_the_program_gets_at_first(counts, budget):
    whole, mixing.EXACT = mixing.EXACT, 16
    try:
        lengths = sorted(counts)
        take = mixing.fit_budget(lengths, [counts[x] for x in lengths], budget)
    finally:
        mixing.EXACT = whole
    reach = 1
    for length, n in counts.items():
        for _ in range(n):
            reach |= reach << length
    assert all(0 <= k <= counts[x] for k, x in zip(take, lengths))
    assert sum(x * k for x, k in zip(lengths, take)) == (reach & (1 << budget + 1) - 1).bit_length() - 1


def test_mix_splits_rows_that_repeat(spark):
    """A source of copies of one row meets its target to within one row's size; clashing names do no harm."""
    rows = [(1, "w " * 7, "a")] * 40 + [(i, "v " * 3, "b") for i in range(100, 140)] + [(None, "u u", None)] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("id", "h", "n", "size", "cut", "own", "_id", "_h", "_copies", "times")})
    got = mixing.mix(frame).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["size"]][0] += r["taken"]
        by[r["size"]][1] = r["target"]
    assert len(got) == len(rows) and all(abs(t - want) <= s for s, (t, want) in by.items())
    made = mixing.mixed_documents(frame)
    assert made.columns == frame.columns
    assert {r["text"]: r["count"] for r in made.groupBy("text").count().collect()} == {t: by[len(t.split())][0] // len(t.split()) for _, t, _ in rows}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), [None, "a", "b", "c", "d"][min(4, int(rng.integers(0, 8)))]) for i in range(600)] + [(None, None, "a"), (7, "again", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and got == mixing.mix(frame).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix(frame).collect()))
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {(d, len((t or "").split())): s for d, t, s in rows}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = by[source[r["doc_id"], r["size"]]]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2] = r["target"]
    sizes = {k: v[0] for k, v in by.items()}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    want = mixing.water_level([sizes[k] for k in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    for k, t in zip(order, want):
        assert abs(by[k][2] - t) < 1e-6 and t <= 2 * sizes[k] + 1e-9 and abs(by[k][1] - t) <= 1.5
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    frame = spark.createDataFrame([(i, f"w{i} " * (i % 9 + 1), "ab"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(frame).collect()}
    made = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(frame).groupBy("doc_id").count().collect()}
    assert made == {k: v for k, v in taken.items() if v}


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i) if i % 50 else None, "é" * int(rng.integers(0, 200))) for i in range(800)] + [(5, None)] * 3 + [(9, "hot")] * 900
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(frame).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    total = [0] * 8
    slots = defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(total) - min(total) <= 2 * 401
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert sharding.shard_documents(frame.limit(0)).count() == 0


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("tie"), F.lit(10).cast("long").alias("size"), F.lit(1).cast("long").alias("n"))
    got = sharding.assign(rows, 4, ranges=64).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [500] * 4
