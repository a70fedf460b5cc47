"""Operator 1: contiguous shards of near-equal bytes, from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import columns, materialize, ordered_totals, read, utf8_bytes

#: Bytes that a row counts besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs``, in ascending id order, into ``shards`` contiguous pieces of near-equal bytes.

    A row's shard is where its middle byte falls among equal cuts of the global byte count, so every shard
    is within one row's size of the target on either side. Only (id, size, checksum) rows are shuffled.

    Returns doc_id, size, text_crc32, law, shard, slot (0.. within the shard, in id order), grown_shard (null:
    this law has no growth rule).

    Defined cases: null text has size 8 and the checksum of no bytes (0); null ids come first; rows that
    repeat an id are ordered by checksum and size, and identical rows are interchangeable; an empty table gives
    no rows; a row larger than a target leaves the shards that it spans empty, other than its own.
    """
    src = columns(docs, id_col, text_col)
    rows = src.select(F.col(id_col).cast("long").alias("doc_id"),
                      (utf8_bytes(F.col(text_col)) + ROW_BYTES).alias("size"),
                      F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = ordered_totals(rows, ["doc_id", "text_crc32", "size"], ["size"], name="op1-sizes")

    cut = F.expr(f"least({shards - 1}, ((2 * _before_size + size) * {shards}) div (2 * _total_size))").cast("int")
    sharded = materialize(placed.select("doc_id", "size", "text_crc32", "_row", cut.alias("shard")), "op1-shards")
    # one row per shard: the bound of this broadcast is the shard count
    first = F.broadcast(sharded.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_first")))
    return sharded.join(first, F.col("shard") == F.col("_s")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"))


ORACLE = {"op1_sharding": """
with tab as (  -- the CRC-32 table: eight shifts of every byte under the reversed polynomial
  select list(v order by i) as t from (
    select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v
    from range(0, 256) as r(i))
), d as (
  select doc_id, coalesce(strlen(text), 0) + 8 as size, hex(encode(coalesce(text, ''))) as h from documents
), p as (
  select doc_id, size, h, sum(size) over (order by doc_id) - size as before, sum(size) over () as total from d
), s as (
  select doc_id, size, h, least(23, ((2 * before + size) * 24) // (2 * total)) as shard from p
)
select doc_id, cast(size as bigint) as size,
       xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2),
                                                  lambda k: cast('0x' || substr(h, 2 * k + 1, 2) as bigint)),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32,
       'bytes' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as integer) as grown_shard
from s, tab
"""}
