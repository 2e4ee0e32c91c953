from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from barloom.llm import bpe, tokenfile
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "the", " the", "ing", "  ", "\n", "\t", "é", "日本", "🙂", "'s", "12", "!!", " ", "ß,", ". "]
texts = st.lists(st.sampled_from(ODD), max_size=30).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def coder():
    return bpe.text_encoder(MULTI, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.encoder.ranks, special_tokens={})


def test_equals_the_library_and_decodes(coder, library):
    @settings(max_examples=300, deadline=None)
    @given(texts)
    def check(text):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()

    check()


def test_appends_and_edits_equal_a_fresh_encoding(coder):
    @settings(max_examples=60, deadline=None)
    @given(st.text("abthe ing", max_size=120), st.integers(0, 120), st.integers(0, 8), st.text("abthe ing", max_size=8))
    def check(text, start, width, new):
        data = text.encode()
        start = min(start, len(data))
        stop = min(start + width, len(data))
        table = bpe.PrefixTable(coder.encoder, data)
        table.replace(start, stop, new.encode())
        want = data[:start] + new.encode() + data[stop:]
        assert table.tokens() == coder.encoder.encode_piece(want) if want else table.tokens() == []
        table.append(b"ing")
        assert table.tokens() == coder.encoder.encode_piece(want + b"ing")

    check()


def test_edit_stays_near(coder):
    table = bpe.PrefixTable(coder.encoder, b"thing and " * 500)
    table.replace(2000, 2001, b"x")
    assert table.recomputed < 200


def documents(spark):
    rows = [(3, "the cat sat,\nthe end."), (None, "no id"), (1, None), (2, ""), (2, "x" * 5000), (5, "the cat sat,\nthe end."), (4, "a\t b  c\n\n d")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_digests_of_odd_rows(spark, library):
    got = bpe.encode_digests(documents(spark), MULTI, public_tokenizers.PATTERN).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 2}
    assert by[1]["n_tokens"] == 0 and by[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    want = np.array(library.encode_ordinary("the cat sat,\nthe end."), "<u4").tobytes()
    assert by[3]["ids_sha256"] == hashlib.sha256(want).hexdigest() == by[5]["ids_sha256"]
    full = bpe.encode_documents(documents(spark).drop("ids"), MULTI, public_tokenizers.PATTERN).filter("doc_id = 4").first()
    assert bytes(full["decoded"]) == b"a\t b  c\n\n d"


def test_packed_values_come_back():
    for n in (0, 1, 3, 4, 5, 1001):
        v = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype(np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint32)
        assert tokenfile.unpack_values(tokenfile.pack_values(v), n).tolist() == v.tolist()
    with pytest.raises(ValueError):
        tokenfile.read_block(b"nonsense")


def test_units_equal_whole_texts():
    coder = tokenfile.batch_tokenizer(JSON)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(texts, min_size=1, max_size=6))
    def check(many):
        assert coder.encode(pa.array(many, pa.string())) == coder.library(many)

    check()


def test_texts_with_added_tokens_equal_whole_texts():
    coder = tokenfile.BatchTokenizer(JSON)
    many = ["one <|endoftext|> two", "<|endoftext|>", "usual words, only.", "a <|endoftext|>.\nb", "foo<|endoftext|>bar", "<|endoftext", "|> ends", "x <|endoftext|>", "", "<|endoftext|><|endoftext|> two"]
    got = coder.encode(pa.array(many, pa.string()))
    assert got == coder.library(many)
    assert np.frombuffer(got[0], "<u4").tolist() == [505, 220, 50256, 734]


def test_added_tokens_with_white_space_equal_whole_texts(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    own = Tokenizer.from_file(JSON)
    own.add_tokens([AddedToken("<a b>", normalized=False), AddedToken("<strip>", lstrip=True, rstrip=True, normalized=False)])
    own.save(str(tmp_path / "own.json"))
    coder = tokenfile.BatchTokenizer(str(tmp_path / "own.json"))
    many = ["x <a b> y", "x <a", "c b> y", "one <strip> two"]
    assert coder.encode(pa.array(many, pa.string())) == coder.library(many)


def test_file_in_id_order(spark):
    import zlib

    file, ranks = tokenfile.write_token_file(documents(spark), JSON)
    got = sorted(tokenfile.read_token_file(file, ranks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5]
    tok = tokenfile.batch_tokenizer(JSON).tokenizer
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    text = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    want = lambda t: zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert all(r["ids_crc32"] == want(text[r["doc_id"]]) for r in got if r["doc_id"] != 2) and got[1]["n_tokens"] == 1
    assert sorted(r["ids_crc32"] for r in got if r["doc_id"] == 2) == sorted(map(want, ("", "x" * 5000)))


def test_every_document_of_a_table_equals_the_library(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["ids_crc32"] for r in tokenfile.read_token_file(*tokenfile.write_token_file(docs, JSON)).collect()}
    tok = tokenfile.batch_tokenizer(JSON).tokenizer
    assert got == {r["doc_id"]: zlib.crc32(np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_digests(none, MULTI, public_tokenizers.PATTERN).count() == 0
    assert tokenfile.read_token_file(*tokenfile.write_token_file(none, JSON)).count() == 0


def test_few_units_held_and_one_hash_for_two_units():
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(made, rng.integers(0, 30))) for _ in range(300)]
    coder = tokenfile.BatchTokenizer(JSON, most=20)
    for low in range(0, 300, 40):
        some = texts[low : low + 40]
        assert coder.encode(pa.array(some)) == coder.library(some)
    assert len(coder.cache.hashes) < 400
    cache, raw, one, two = tokenfile.UnitCache(10), np.frombuffer(b"oneduo", np.uint8), np.array([0, 3]), np.array([3, 6])
    hashes, ids = np.array([7], np.uint64), np.array([1, 2], "<u4")
    cache.add(hashes, raw, one[:1], two[:1], ids, np.array([2]))
    assert not len(cache.missing(hashes, raw, one[:1], two[:1])) and len(cache.missing(hashes, raw, one[1:], two[1:])) == 1
    cache.add(hashes, raw, one[1:], two[1:], ids[:1] + 8, np.array([1]))
    assert not len(cache.missing(hashes, raw, one[1:], two[1:])) and len(cache.hashes) == 1
    first, count = cache.places(hashes)
    assert cache.ids[first[0] : first[0] + count[0]].tolist() == [9]


def test_idle_workers_drop_their_caches(monkeypatch):
    import time

    from barloom.llm import common

    monkeypatch.setattr(common, "IDLE_S", 0.2)
    dropped = []

    def task(batches):
        for x in batches:
            common.cached_here(lambda: dropped.append(x))
            time.sleep(0.5)
            yield x

    assert list(common.releasing(task, iter([1, 2]))) == [1, 2] and not dropped
    assert list(common.releasing(task, iter([3]))) == [3] and not dropped  # a task in time keeps them
    time.sleep(1)
    assert len(dropped) == 3
    assert not common._caches and not common._powers


def test_workers_of_arrow_operators_need_no_pandas():
    """pandas would stay in every Python worker beside an executor."""
    import subprocess
    import sys

    code = "import sys, barloom.llm.bpe, barloom.llm.jaccard, barloom.llm.html, barloom.llm.chat; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"
