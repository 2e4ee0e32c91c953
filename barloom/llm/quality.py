"""Quality rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and neighbouring word pairs are hashed into buckets. Counts over every document give the raw multinomial, counts
over trusted documents the target's, smoothed towards the raw one by PRIOR words. A document's score is the mean over its
n-grams of log(target / raw). The threshold is the score that all but the share LOST of the trusted documents reach, each
scored by the counts of the half it is not in; so it follows from the tables alone, by one rule at every size, and every
document is held against it. Column functions only.

Defined results: null text has no words; a document that fails a base rule is not kept, whatever its score; without
trusted documents every ratio is 1 and only the base rules count; scores are compared in steps of 1 / GRID, and a tie with
the threshold is kept; texts of any length are read whole, and their repeated words are counted exactly; an empty table
gives no rows; repeated rows are scored alike; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored, text_or_empty

SPACE = " \t\n\x0b\f\r"
#: Hash buckets (a power of two), whose weights travel as one constant of the query.
BUCKETS = 8192
#: Words of raw corpus that the target's counts are smoothed with.
PRIOR = 20_000
#: Share of trusted documents that the threshold may refuse.
LOST = 0.005
#: Trusted rows that are counted, about; more are thinned by a hash of their id. The threshold is set by all of them.
TRUSTED_ROWS = 100_000
#: Steps of the score in 1.
GRID = 10_000


#: Columns that judge() adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    """Words of a text that is not null: it is split at one character, which takes no pattern, and empty parts are removed."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _left(x: Column, by: int | Column) -> Column:
    return F.call_function("shiftleft", x, by if isinstance(by, Column) else F.lit(by))


def _covered(starts: Column) -> Column:
    """Words in three-word windows that start at these sorted places."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def with_repeated_words(worded: DataFrame) -> DataFrame:
    """with_words() and n_repeat_words: the words in three-word windows found twice or more.

    A text whose windows all have hashes of their own repeats none. Elsewhere windows are sorted by hash, in one long with
    their place, so that equal ones are neighbours; then their words are compared. A text where windows of one hash differ
    has its windows sorted by their words. Each array is a column of its own: what a lambda function refers to must be an
    attribute, or it would be computed again for every element.
    """
    n = F.size("_h")
    same = lambda a, b: F.call_function("shiftright", a.bitwiseXOR(b), F.col("_bits")) == 0
    place = lambda x: x.bitwiseAND(F.col("_mask")).cast("int")
    word = lambda x, k: F.get("_words", place(x) + k)
    places = F.sequence(F.lit(0), n - 3)

    def neighbours(keys: str, equal) -> Column:  # beyond the ends there is null, which equals nothing
        return F.filter(keys, lambda x, j: equal(F.get(keys, j - 1), x) | equal(F.get(keys, j + 1), x))

    bits = F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1.0)).cast("int")
    keyed = worded.withColumn("_bits", bits).withColumn("_mask", _left(F.lit(1).cast("long"), F.col("_bits")) - 1)
    windows = F.transform(F.slice("_h", 3, n), lambda h, i: _left(F.get("_pairs", i), 1).bitwiseXOR(h))
    keyed = keyed.withColumn("_windows", F.when(F.size("_pairs") > 2, windows))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    keyed = keyed.withColumn("_keys", F.when(again, F.sort_array(F.transform("_windows", lambda w, i: _left(w, F.col("_bits")).bitwiseOR(i.cast("long"))))))
    found = keyed.withColumn("_twice", neighbours("_keys", same))
    differ = lambda a, b: same(a, b) & ((word(a, 0) != word(b, 0)) | (word(a, 1) != word(b, 1)) | (word(a, 2) != word(b, 2)))
    met = F.exists(F.sequence(F.lit(1), F.size("_twice") - 1), lambda j: differ(F.get("_twice", j - 1), F.get("_twice", j)))
    found = found.withColumn("_met", F.when(F.size("_twice") > 1, met).otherwise(F.lit(False)))
    exact = F.transform(places, lambda i: F.struct(*(F.get("_words", i + k).alias(f"w{k}") for k in range(3)), i.alias("i")))
    found = found.withColumn("_exact", F.when(F.col("_met"), F.sort_array(exact)))
    alike = lambda a, b: F.coalesce((a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))
    found = found.withColumn("_starts", F.when(F.col("_met"), F.transform(neighbours("_exact", alike), lambda x: x["i"])).otherwise(F.transform("_twice", place)))
    count = F.coalesce(_covered(F.sort_array("_starts")), F.lit(0))
    return found.withColumn("n_repeat_words", count.cast("long")).drop("_bits", "_mask", "_windows", "_keys", "_twice", "_met", "_exact", "_starts")


def with_words(docs: DataFrame) -> DataFrame:
    """docs with _words of _text, _h (the words' hashes) and _pairs (hashes of each word and the next)."""
    hashed = docs.withColumn("_words", words_of(F.col("_text"))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_pairs", F.transform(F.slice("_h", 2, F.size("_h")), lambda h, i: _left(F.get("_h", i), 1).bitwiseXOR(h)))


def with_base_rules(worded: DataFrame) -> DataFrame:
    """with_words() and the counts of the base rules, and base_failed."""
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    counted = worded.withColumn("_lines", lines).withColumns(
        {
            "n_words": F.size("_h").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_repeated_words(counted.drop("_lines")).withColumn("base_failed", failed)


def bucket(h: Column) -> Column:
    """The bucket of a word's or a pair's hash."""
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def ratio_weights(worded: DataFrame, trusted: DataFrame) -> list[list[float]]:
    """log(target / raw) of each bucket: by both halves of trusted (_id, _half), by the first, by the second.

    The driver gets one row for each bucket.
    """
    marked = worded.join(F.broadcast(trusted.withColumnRenamed("_id", "_trusted")), F.col("_id") == F.col("_trusted"), "left")
    each = marked.select(F.explode(F.concat(F.transform("_h", bucket), F.transform("_pairs", bucket))).alias("b"), "_half")
    halves = [F.sum((F.col("_half") == k).cast("long")).alias(f"t{k}") for k in (0, 1)]
    rows = each.groupBy("b").agg(F.count("*").alias("raw"), *halves).collect()
    raw, target = [1] * BUCKETS, [[0] * BUCKETS for _ in range(3)]
    for r in rows:
        raw[r["b"]] += r["raw"]
        for k in (0, 1):
            target[1 + k][r["b"]] = r[f"t{k}"] or 0
            target[0][r["b"]] += r[f"t{k}"] or 0
    all_raw = sum(raw)

    def weights(counts: list[int]) -> list[float]:
        size = sum(counts)
        return [math.log((t + PRIOR * n / all_raw) / (size + PRIOR) * all_raw / n) if size else 0.0 for n, t in zip(raw, counts)]

    return [weights(t) for t in target]


def score(weights: list[float], first: Column | None = None) -> Column:
    """Mean weight over the n-grams of a row of with_words(); 0 without any. `first` is the place of bucket 0's weight, if not 0."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one constant
    add = lambda a, h: a + F.get(table, bucket(h) if first is None else first + bucket(h))
    total = F.aggregate("_pairs", F.aggregate("_h", F.lit(0.0), add), add)
    return F.coalesce(F.try_divide(total, F.size("_h") + F.size("_pairs")), F.lit(0.0))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """_id and _half (0 or 1) of the distinct documents of quality 1."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    return good.withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)).cast("int"))


def steps(value: Column) -> Column:
    """The score as a whole number of steps."""
    return F.round(value * GRID).cast("long")


def threshold(docs: DataFrame, trusted: DataFrame, n: int, weights: list[list[float]]) -> int | None:
    """The step that all but the share LOST of trusted documents of 50 words or more reach, scored by the other half's weights.

    The driver gets one row for each step that is found.
    """
    _, first, second = weights
    # Shorter documents have null: a filter would be moved below the words and split the texts a second time.
    held = lambda value: F.when(F.size("_h") >= 50, steps(value))
    if n <= TRUSTED_ROWS:
        own = score(second + first, F.col("_half") * BUCKETS)
        found = with_words(docs.join(F.broadcast(trusted), "_id")).select(held(own).alias("s"))
    else:  # ids and scores are moved, not texts
        both = with_words(docs).select("_id", held(score(first)).alias("s0"), held(score(second)).alias("s1"))
        found = both.join(trusted, "_id").select(F.when(F.col("_half") == 0, F.col("s1")).otherwise(F.col("s0")).alias("s"))
    counts = sorted((r["s"], r["n"]) for r in found.groupBy("s").agg(F.count("*").alias("n")).collect() if r["s"] is not None)
    below, lost = 0, LOST * sum(c for _, c in counts)
    for step, c in counts:
        below += c
        if below > lost:
            return step
    return None


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the columns RESULTS, in place of columns of those names."""
    extra = {c: f"x{i}" for i, c in enumerate(docs.columns) if c not in RESULTS}  # names that clash with none here
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in extra.items()), F.col(id_column).alias("_id"), text_or_empty(text_column).alias("_text"))
    trusted = stored(trusted_ids(labels), "quality-trusted")
    n = trusted.count()
    counted = trusted if n <= TRUSTED_ROWS else trusted.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * TRUSTED_ROWS / n))
    worded = with_words(plain)
    weights = ratio_weights(worded, counted)
    least = threshold(plain.select("_id", "_text"), trusted, n, weights) if any(weights[0]) else None
    # A filter on a result must not be moved below the arrays: it would put their expressions inside each other's lambda
    # functions. Filters are not moved below a column that depends on the partition, so every result refers to one.
    scored = with_base_rules(worded).withColumn("score", score(weights[0])).withColumn("_here", F.spark_partition_id() >= 0)
    passed = F.lit(True) if least is None else steps(F.col("score")) >= F.lit(least)
    judged = scored.withColumn("kept", ~F.col("base_failed") & passed)
    return judged.select(*(F.col(x).alias(c) for c, x in extra.items()), *(F.when(F.col("_here"), F.col(c)).alias(c) for c in RESULTS))
