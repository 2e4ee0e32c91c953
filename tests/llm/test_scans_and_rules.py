from __future__ import annotations

import hashlib
import re
from collections import Counter

from barloom.llm import quality, secrets
from pyspark.sql import functions as F

KEY = "AKIA" + "Z9" * 8
TEXTS = [
    f"say password = 'abcdefghijkl0' and {KEY}, deadbeefdeadbeef00 ok", "token: secret: abcdefghijklmnop", "TOKEN=password=abcdefghijklmnop", None, "", "api_key:short\nApiKey : abcdefghijklmnopq",
    "é🙂 secret=abcdefghijkl", "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "x" * 50000, "0123456789abcde", "AKIAKIA" + "A" * 14, "secret" * 3000,
]


def brute(text: str) -> list[tuple[int, int, int]]:
    out = []
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def test_spans_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans_", F.lit(1)).withColumn("rules", F.lit("clash"))
    for r in secrets.digests(rows).collect():
        want = brute(TEXTS[r["doc_id"]] or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r["doc_id"], r["spans"], said)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[1] == k for w in want) for k in range(3))


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.digests(docs).collect():
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[1] == k for w in brute(text[r["doc_id"]])) for k in range(3))


def test_queries_of_patterns():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is None
    assert secrets.trigram_query(r"a(bc|de)f") == sorted([frozenset({"abc", "bcf"}), frozenset({"ade", "def"})], key=sorted)


def test_redaction_and_empty_table(spark):
    rows = spark.createDataFrame([(1, TEXTS[0]), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(rows).collect()}
    assert got == {1: "say [SECRET]' and [SECRET], [SECRET] ok", 2: "nothing", 3: None}
    clash = secrets.redacted(rows.withColumns({"spans": F.lit("own"), "rules": F.lit(5)})).filter("doc_id = 1").first()
    assert (clash["spans"], clash["rules"], clash["text"]) == ("own", 5, got[1])
    assert secrets.digests(rows.limit(0)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text: str) -> tuple:
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


ODD = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z", "é#\t🙂 $\x0b a|b", "a b c d " * 30, "w " * 20000, "\n".join(f"l{i % 3} m n" for i in range(40))]


def test_base_rules_equal_brute_force(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "null id")], "doc_id long, text string").withColumn("score_", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for rows, tags in ((docs, labels), (whole, spark.read.parquet(f"{sf}/labels.parquet"))):
        for r in quality.judge(rows, tags).collect():
            got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert got == base(r["text"] or ""), (r["doc_id"], got)
            assert not (r["kept"] and r["base_failed"])
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_ratio_tells_held_out_labels_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    held = quality.judge(docs, train).join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.05 * (n.get((1, True), 0) + n.get((1, False), 0))
    good, bad = (held.filter(f"quality = {q}").agg(F.median("score")).first()[0] for q in (1, 0))
    assert good > bad


def test_score_reads_each_gram_once(spark, sf):
    """The place of a table in a longer one gives its weights; a plan hashes words once, and no window or n-gram again."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("_text", F.coalesce("text", F.lit("")))
    size = quality.BUCKETS
    weights = [(i % 97 - 40) / 7 for i in range(2 * size)]
    for r in quality.with_words(rows).withColumn("got", quality.score(weights, F.lit(size))).collect():
        h = r["_h"]
        assert r["_words"] == WORD.findall(r["_text"])
        grams = [*h, *((a << 1) ^ b for a, b in zip(h, h[1:]))]
        assert abs(r["got"] - sum(weights[size + g % size] for g in grams) / max(1, len(grams))) < 1e-9
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.judge(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.count("aggregate(") == 3
