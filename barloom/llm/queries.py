"""The training-data queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barloom.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barloom.llm.tokenfile import read_token_file, write_token_file

    return read_token_file(*write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


@query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from barloom.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from barloom.llm.chat import format_conversations, read_digests

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_digests(format_conversations(rows.unionByName(more)))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.jaccard import components

    return components(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op10_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.jpeg import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


@query
def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def _scan_sql() -> str:
    """Spans by rule: what lies between matches, and the matches before, give a match's place."""
    from barloom.llm.secrets import BASE, RULES

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " union all ".join(
        f"select rid, {k} as kind_no, '{r.kind}' as kind, string_split_regex(text, {quoted(r.java)}) as parts, regexp_extract_all(text, {quoted(r.java)}) as m, {quoted(r.java)} as p, {r.least} as least from d where regexp_matches(text, {quoted(r.java)})"
        for k, r in enumerate(RULES)
    )
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents), r as ({each}), k as (select *, unnest(range(1, len(m) + 1)) as k from r),
  s as (select rid, kind_no, kind, m[k] as found, p, least, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::bigint as a from k),
  o as (select rid, kind_no, a, kind || ':' || a || ':' || (a + length(found)) as said from s where least = 0 or length(regexp_extract(found, p, 2)) >= least),
  g as (select rid, count_if(kind_no = 0) as n0, count_if(kind_no = 1) as n1, count_if(kind_no = 2) as n2, string_agg(said, ',' order by a, kind_no) filter (kind_no < {len(BASE)}) as base, string_agg(said, ',' order by a, kind_no) as spans from o group by rid)
  select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"""


ORACLES["op1_secret_scan"] = _scan_sql()
ORACLES["op3_chat_format"] = """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e as (select *, length(text) + len(regexp_extract_all(text, '\\\\|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|\\[ROLE\\]|\\[NAMED\\]|\\[/ROLE\\]')) + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 9 else 22 + length(role) end as chars,
    lag(role) over (partition by conv_id order by turn, role, text) as before from t)
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars,
    bool_and(case when before is null then role in ('system', 'user') when before = 'user' then role = 'assistant' when before in ('system', 'assistant') then role = 'user' else false end) as valid from e group by conv_id"""
