"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.decontaminate import leaks
from loomgrid.llm.exact_dedup import exact_duplicates
from loomgrid.llm.labelled_urls import labelled_urls
from loomgrid.llm.mixing import mix_sources
from loomgrid.llm.secrets import secret_spans
from loomgrid.llm.sharding import stratified_shards
from loomgrid.llm.simhash import near_duplicates
from loomgrid.llm.token_counts import token_counts
from loomgrid.llm.token_files import token_table
from loomgrid.llm.toxicity import toxicity
from loomgrid.llm.url_filter import judge_urls

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 24
SOURCE_WEIGHTS = (5, 2, 1)
SOURCE_CAP = 3
MIX_SEED = 11
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
PIECES = "piece_bpe_32k.model"
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_table(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, SOURCE_CAP, MIX_SEED)
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("times") * F.col("size")).alias("taken"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES, labelled_urls(spark))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXIC_FROM)
    return rated.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))
    return counted.select(F.col("id").alias("doc_id"), "n_words", "n_tokens")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


OP3_SQL = f"""
with words as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
         substr(md5('{MIX_SEED}:' || coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, '')))), 1, 15) as h
  from documents
), sizes as (
  select source, sum(size) as source_size from words group by source
), weighed as (
  select *, (case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end) as weight from sizes
), staged as (
  select *, {SOURCE_CAP} * source_size as most, sum(source_size) over () as total,
         coalesce(sum({SOURCE_CAP} * source_size) over (order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
         sum(weight) over (order by source_size / weight, source asc nulls last rows between current row and unbounded following) as open_weight
  from weighed
), judged as (
  select *, most * open_weight <= weight * (total - filled) as capped from staged
), levels as (
  select *, cast(total - sum(case when capped then most else 0 end) over () as double)
            / nullif(cast(sum(case when capped then 0 else weight end) over () as double), 0) as level from judged
), targets as (
  select source, source_size, case when capped then cast(most as double) else weight * level end as target from levels
), budgets as (
  select *, case when source_size > 0 then least({SOURCE_CAP}, floor(target / cast(source_size as double))) else 0 end as whole from targets
), runs as (
  select w.doc_id, w.size, b.source_size, b.target, b.whole, w.source, w.h,
         case when whole < {SOURCE_CAP} then target - whole * source_size else 0 end as budget,
         sum(w.size) over (partition by w.source order by w.h) as upto,
         sum(w.size) over (partition by w.source, w.h) as here
  from words w join budgets b on w.source is not distinct from b.source
)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, round(target, 6) as target,
       cast((whole + case when budget > 0 and (upto < budget or (upto - here < budget and 2 * (budget - (upto - here)) >= here)) then 1 else 0 end) * size as bigint) as taken
from runs
"""

OP6_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


#: DuckDB has no checksum of this kind; its 256 constants come from the polynomial, eight steps each.
OP9_SQL = f"""
with constants as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
         case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as of_byte
), ranked as (
  select doc_id, coalesce(text, '') as t, coalesce('=' || source, 'null') as stratum, count(*) over (partition by source) as members,
         row_number() over (partition by source order by md5('17:' || cast(doc_id as varchar)), doc_id) as rank
  from documents
), placed as (
  select doc_id, t, row_number() over (order by (2 * rank - 1) / (2 * members), stratum) - 1 as place, count(*) over () as n from ranked
), dealt as (
  select *, place * {SHARDS} // n as shard from placed
)
select doc_id, cast(strlen(t) + 8 as bigint) as size,
       cast(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(t), '..'), lambda b: cast('0x' || b as bigint))),
            lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1]))) as bigint) as text_crc32,
       'rows' as law, cast(shard as integer) as shard, cast(place - (shard * n + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as integer) as grown_shard
from dealt, constants
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontaminate": op2_decontaminate,
        "op3_mix_sources": op3_mix_sources,
        "op4_url_filter": op4_url_filter,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_token_counts": op8_token_counts,
        "op9_sharding": op9_sharding,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op9_sharding": OP9_SQL}
