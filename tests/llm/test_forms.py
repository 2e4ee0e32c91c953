from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest
from barloom.llm import chat, html, jpeg
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "[", "<", "ok", " ", "\n", "[ROLE]", "[NAMED]", "S>>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]"]), st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    text = "".join(t for t, _ in chat.INSTRUCT.segments(turns))
    assert [(r, t) for r, t, _ in chat.INSTRUCT.parse(text)] == turns


def test_machine():
    assert chat.INSTRUCT.check(["system", "user", "assistant", "user"]) is None
    assert chat.INSTRUCT.check(["user", "user"]) == 1 and chat.INSTRUCT.check(["assistant"]) == 0 and chat.INSTRUCT.check(["user", "tool"]) == 1


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "user", "x"), (2, 0, None, None), (3, 0, "assistant", "</s>é🙂"), (None, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_digests(chat.format_conversations(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b") and got[1]["valid"]
    assert got[2]["turns_sha256"] == sha("user\nx\n\n\n\n\n") and got[2]["n_turns"] == 3 and not got[2]["valid"]
    assert got[3]["loss_chars"] == 6 and not got[3]["valid"] and got[None]["n_turns"] == 1
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_loss_comes_from_the_emitted_flags(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "[INST] b")] * 2, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(rows).cache()
    got = chat.read_digests(made).first()
    assert got["n_turns"] == 4 and got["loss_sha256"] == hashlib.sha256(b"[INST] b[INST] b").hexdigest()
    wrong = made.withColumn("segments", F.transform("segments", lambda s: s.withField("loss", ~s["loss"])))
    with pytest.raises(Exception, match="segments differ"):
        chat.read_digests(wrong).collect()


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 6000, 70000])
def test_payloads_come_back(n):
    payload = jpeg.padded(np.random.default_rng(n).bytes(n))
    image = jpeg.Image(jpeg.encode(payload))
    assert image.payload() == payload
    assert image.rgb().shape == (image.height, image.width, 3)


def test_symbol_by_symbol_reading_agrees(monkeypatch):
    data = jpeg.encode(np.random.default_rng(1).bytes(1500))
    fast = jpeg.Image(data)
    monkeypatch.setattr(jpeg.Image, "_read_fixed", lambda *a: False)
    slow = jpeg.Image(data)
    assert all((a == b).all() for a, b in zip(fast.coefficients, slow.coefficients))


class Writer:
    """A plain encoder of sparse grey progressive scans, bit by bit, with every symbol in a flat table of eight-bit codes."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v: int) -> int:
        size = abs(v).bit_length()
        return v if v > 0 else v + (1 << size) - 1

    def data(self) -> bytes:
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def sparse_image(blocks: np.ndarray) -> bytes:
    """DC, then AC with runs of zeros and of empty blocks at half precision, then both refined."""
    symbols = list(range(255))
    table = lambda kind: jpeg._segment(0xC4, bytes([kind, *[0] * 7, 255, *[0] * 8, *symbols]))
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65))), jpeg._segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * len(blocks), 1) + bytes([1, 0x11, 0])), table(0x00), table(0x10)]
    half = np.sign(blocks) * (np.abs(blocks) >> 1)
    w, last = Writer(), 0
    for b in blocks:
        diff = (int(b[0]) >> 1) - last
        last = int(b[0]) >> 1
        w.put(abs(diff).bit_length(), 8)
        if diff:
            w.put(w.signed(diff), abs(diff).bit_length())
    out.append(jpeg._scan([(1, 0)], 0, 0, 0, 1, w.data()))
    w, run = Writer(), 0

    def flush() -> None:
        nonlocal run
        while run:
            n = min(run.bit_length() - 1, 14)
            w.put(n << 4, 8)
            w.put(run - (1 << n) if run < 2 << n else (1 << n) - 1, n)
            run -= min(run, (2 << n) - 1)

    for b in half:
        where = [k for k in range(1, 64) if b[k]]
        if not where:
            run += 1
            continue
        flush()
        before = 0
        for k in where:
            zeros = k - before - 1
            while zeros > 15:
                w.put(0xF0, 8)
                zeros -= 16
            size = abs(int(b[k])).bit_length()
            w.put(zeros << 4 | size, 8)
            w.put(w.signed(int(b[k])), size)
            before = k
        if before < 63:
            run += 1
    flush()
    out.append(jpeg._scan([(1, 0)], 1, 63, 0, 1, w.data()))
    w = Writer()
    for b, h in zip(blocks, half):
        new = [k for k in range(1, 64) if b[k] and not h[k]]
        k = 1
        for target in new:
            while True:  # at most 15 zeros go before a new value; 16 go under a symbol of their own
                zeros = [j for j in range(k, target) if not h[j]]
                if len(zeros) <= 15:
                    break
                stop = zeros[15]
                w.put(0xF0, 8)
                for j in range(k, stop):
                    if h[j]:
                        w.put(abs(int(b[j])) & 1, 1)
                k = stop + 1
            w.put(len(zeros) << 4 | 1, 8)
            w.put(1 if b[target] > 0 else 0, 1)
            for j in range(k, target):
                if h[j]:
                    w.put(abs(int(b[j])) & 1, 1)
            k = target + 1
        if k < 64:
            w.put(0, 8)
            for j in range(k, 64):
                if h[j]:
                    w.put(abs(int(b[j])) & 1, 1)
    out.append(jpeg._scan([(1, 0)], 1, 63, 1, 0, w.data()))
    w = Writer()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out.append(jpeg._scan([(1, 0)], 0, 0, 1, 0, w.data()))
    return b"".join([*out, b"\xff\xd9"])


def test_sparse_scans_with_runs_and_refinement():
    rng = np.random.default_rng(2)
    blocks = (rng.integers(-40, 41, (30, 64)) * (rng.random((30, 64)) < 0.12)).astype(np.int64)
    blocks[5:14, 1:] = 0
    image = jpeg.Image(sparse_image(blocks))
    assert (image.coefficients[0][0] == blocks).all()
    exact = np.zeros((64, 64))
    for u in range(64):
        y, x = divmod(int(jpeg.ZIGZAG[u]), 8)
        exact[u] = np.outer(jpeg._DCT[y], jpeg._DCT[x]).reshape(-1)
    want = np.clip(np.rint((blocks * np.arange(1, 65)) @ exact + 128), 0, 255).reshape(30, 8, 8).transpose(1, 0, 2).reshape(8, -1)
    assert np.abs(image.planes()[0].astype(int) - want).max() <= 1


def test_media_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 3000), (4, "same"), (5, "same"), (None, "z")], "doc_id long, text string").withColumn("media", F.lit(0))
    got = {r["doc_id"]: r for r in jpeg.media_digests(rows).collect()}
    assert got[1]["payload_sha256"] == got[2]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert got[3]["n_bytes"] == 6000 and got[3]["payload_bytes"] == 6144 and got[4]["feature"] == got[5]["feature"] and len(got) == 6
    kept = jpeg.tensors(jpeg.media(rows.drop("media"))).filter("doc_id = 3").first()
    assert len(kept["rgb"]) == kept["height"] * kept["width"] * 3
    assert jpeg.media_digests(rows.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<ul class="menu"><li><a href=x>Home</a></li><li><a>About us</a></li></ul><div class="cookie-notice"><p>We use cookies on this site to make all of it better for everyone who reads.</p></div>
<div id="content">{0}<h2>Title of&nbsp;it</h2><p>First para with a good length of text, it goes on and on
 for a while.</p><p>Second &amp short.<br>Yes.</p><div class="ad">Buy now, it is cheap today and only today, so buy it.</div><p>Third para with a good length of text, it goes on &lt;and&gt; on for a while.</p>{1}</div>
<aside><p>Other stories you may like to read today and tomorrow</p></aside><form><p>Sign up for our letter with your name here please now</p></form><div id="comments"><div class="comment"><p>I like this text very much, thanks for sharing.</p></div></div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("tags", [("", ""), ("<article>", "</article>")])
def test_main_text(tags):
    want = "Title of it\n\nFirst para with a good length of text, it goes on and on for a while.\n\nSecond & short. Yes.\n\nThird para with a good length of text, it goes on <and> on for a while."
    assert html.main_text(PAGE.replace("{0}", tags[0]).replace("{1}", tags[1])) == want


def test_pages_of_odd_rows(spark, sf):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<article><p>a < b <b>c"), (5, "u", "<nav><p>menu"), (6, "u", "<article>" + "<p>x</p>" * 5000), (None, "u", "<!-- open")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(rows).collect()}
    assert got[1] == got[2] == got[3] == got[5] == got[None] == "" and got[4] == "a < b c" and got[6].count("x") == 5000
    pages = html.extract(spark.read.parquet(f"{sf}/pages.parquet"))
    assert pages.filter("n_chars = 0").isEmpty() and html.extract(rows.limit(0)).count() == 0


def test_surges_and_dives():
    assert html.between([0, 0, 0, 50, 60, 0, 0, 0, 0, 5, 0, 0, 0], 86) == [False, False, True, True, True, *[False] * 8]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=30))
def test_surges_and_dives_equal_brute_force(weights):
    sums = [sum(w for j, w in enumerate(weights) if i <= j < i + html.WINDOW) for i in range(len(weights))]
    assert html.window_sums(weights) == sums
    # A line is kept if, from the last surge at or before it on, no window is empty.
    want = [any(sums[k] > 86 and all(sums[k : i + 1]) for k in range(i + 1)) for i in range(len(weights))]
    assert html.between(weights, 86) == want


def test_line_blocks_decide_without_an_article():
    prose = ["Long enough to be prose, this paragraph goes on and on and says a good deal more than that.", "A short one."]
    page = "<div><a href=x>Home</a> <a href=y>About us and all our many friends who write here</a></div><div>Hi.</div><div></div><p></p><div></div>"
    page += "<ul><li><a href=z>One link of many</a></li></ul>" * 4 + f"<h1>Title</h1><p>{prose[0]}</p><p>{prose[1]}</p>" + "<ul><li><a href=z>One link of many</a></li></ul>" * 4 + "<div>Bye.</div>"
    assert html.main_text(page) == "\n\n".join(["Title", *prose])


def test_marks_inside_an_article():
    page = "<article class='post sponsored'><h2 id=discussion>Discussion</h2><p id=notice>A notice.</p><section id=search><p>On search.</p></section><section id=comments><p>Mine!</p></section><div class=ad>Buy</div></article><div>Out</div>"
    assert html.main_text(page) == "Discussion\n\nA notice.\n\nOn search."


@pytest.mark.parametrize("text", ["<a ", '<a " ', '<a "> ', "<!-- ", "<script>", "<", "<p class='", "<svg>", '<a href="x>', "a&"])
def test_broken_pages_take_time_in_proportion(text):
    import time

    start = time.process_time()
    html.main_text(text * 200_000)
    assert time.process_time() - start < 5
