"""One query for each operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, line_dedup, lm_score, quality_crf, simhash, sp_codec, token_counts, warc
from .common import crc_mod, read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=100)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), crc_mod(F.col("doc_id"), 7) != 2)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    labels = read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    return quality_crf.quality(docs, quality_crf.fit(docs, labels)).drop("text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_token_counts, op3_simhash, op4_ann, op5_lm_score, op6_decontam, op7_sentencepiece, op8_langid, op9_quality_crf, op10_warc)
}

LINE_DEDUP_SQL = r"""
with cut as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text is not null and doc_id is not null
), numbered as (
  select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from cut
), lines as (
  select doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[\x09-\x0D ]+'), lambda x: x <> '') as w from numbered
), full_lines as (
  select doc_id, line_no, w, len(w) as n, array_to_string(w, ' ') as s, doc_id * 1000000 + line_no as id from lines where len(w) > 0
), firsts as (
  select s, any_value(w) as w, any_value(n) as n, min(id) as id from full_lines group by s
), long_lines as (
  select * from firsts where n >= 4
), gone as (
  select id, n, i, array_to_string(w[1:i-1], ' ') as p, array_to_string(w[i+1:n], ' ') as q
  from long_lines, unnest(range(1, n + 1)) as t(i)
), swaps as (
  select id, min(id) over (partition by n, i, p, q) as keeper from gone where n >= 5
), short_lines as (
  select id as short_id, n, s from long_lines
), drops as (
  select distinct g.id as long_id, b.short_id from gone g join short_lines b
  on g.n >= 5 and b.n = g.n - 1 and b.s = (case when g.p = '' then g.q when g.q = '' then g.p else g.p || ' ' || g.q end)
), near as (
  select id, min(keeper) as keeper from (
    select id, keeper from swaps where keeper < id
    union all select greatest(long_id, short_id), least(long_id, short_id) from drops
  ) group by id
)
select l.doc_id, cast(l.line_no as integer) as line_no,
  cast(case when l.id <> f.id then f.id else near.keeper end // 1000000 as bigint) as keeper_doc,
  cast(case when l.id <> f.id then f.id else near.keeper end % 1000000 as integer) as keeper_line,
  case when l.id <> f.id then 'exact' when near.keeper is not null then 'near' else 'kept' end as kind
from full_lines l join firsts f on l.s = f.s left join near on near.id = f.id
"""

WARC_SQL = r"""
with p as (
  select page_id, url, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages
), q as (
  select *, min(page_id) over (partition by body) as head from p
)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (((instr('0123456789abcdef', substr(hex, cast(5 * i // 4 + 1 as integer), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(hex, cast(5 * i // 4 + 2 as integer), 1)) - 1) >> cast(3 - 5 * i % 4 as integer)) & 31 as integer), 1)), '') as payload_digest,
  case when head is null or page_id = head then 'response' else 'revisit' end as record_type,
  case when head is null or page_id = head then null else head end as refers_to, url
from q
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op10_warc": WARC_SQL}
