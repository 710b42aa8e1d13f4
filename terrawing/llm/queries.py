"""Queries of the text and matching operators (p6 to p9) on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrawing.llm.mixing import draw, rates, shares
from terrawing.llm.nearest import nearest
from terrawing.llm.packing import ITEMS_PER_BUCKET, fill, pack
from terrawing.llm.pii import found_items, redacted
from terrawing.llm.tokens import with_tokens
from terrawing.runtime import cut, table

TOLERANCE_S = 0.5
SEED = 20240607
#: Kinds of container that one pass over the texts packs; more go in further passes.
KINDS_A_PASS = 100


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate with a time, of a track that may have a clock, with its nearest sample, or null if none is near enough."""
    unclocked = table(spark, sf_dir, "tracks").where("has_timestamps = false").select("track_id")
    candidates = table(spark, sf_dir, "candidates").join(unclocked, "track_id", "left_anti")
    pairs = nearest(candidates, table(spark, sf_dir, "telemetry"), "track_id", "timestamp_s", "t", "frame_index", "source_index", TOLERANCE_S)
    return pairs.select("track_id", F.col("frame_index").cast("int").alias("frame_index"), F.col("nearest_id").cast("int").alias("source_index"), F.round("apart_s", 6).alias("apart_s"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_nearest(spark, sf_dir).where("source_index is not null").select("track_id", "frame_index", "source_index").distinct()


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [tuple(r) for r in table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").toLocalIterator()]
    sizes = cut(spark, with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id"]))
    buckets = -(-sizes.count() // ITEMS_PER_BUCKET)
    out = pack(sizes, "doc_id", "n_tokens", dict(kinds[:KINDS_A_PASS]), buckets)
    for i in range(KINDS_A_PASS, len(kinds), KINDS_A_PASS):
        out = out.unionByName(pack(sizes, "doc_id", "n_tokens", dict(kinds[i : i + KINDS_A_PASS]), buckets))
    return out


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every piece of a text larger than a container, for both kinds."""
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    sourced = table(spark, sf_dir, "documents").where("source is not null")
    sizes = cut(spark, with_tokens(sourced, "text", ["doc_id", "source"]))
    return draw(sizes, "doc_id", "source", "n_tokens", rates(sizes, "doc_id", "source", "n_tokens", targets, SEED), SEED)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn copies in shuffled order."""
    return _mix(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_items(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_pos")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p6_found": p6_found,
    "p6_nearest": p6_nearest,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_NEAREST = """
    with c as (select distinct track_id, frame_index, timestamp_s from candidates
               where timestamp_s is not null and track_id not in (select track_id from tracks where not has_timestamps)),
    s as (select distinct track_id, source_index, t from telemetry),
    b as (select c.*, s.source_index as si, s.t from c asof left join s on c.track_id = s.track_id and c.timestamp_s >= s.t),
    a as (select c.*, s.source_index as si, s.t from c asof left join s on c.track_id = s.track_id and c.timestamp_s <= s.t),
    u as (select * from b union all select * from a),
    n as (select track_id, frame_index, timestamp_s, si, t,
                 row_number() over (partition by track_id, frame_index, timestamp_s order by case when round(abs(t - timestamp_s), 6) <= 0.5 then abs(t - timestamp_s) end nulls last, t) as k from u)
    select track_id, frame_index, case when round(abs(t - timestamp_s), 6) <= 0.5 then si end as source_index,
           case when round(abs(t - timestamp_s), 6) <= 0.5 then round(t - timestamp_s, 6) end as apart_s from n where k = 1"""

SQL = {
    "p6_nearest": _NEAREST,
    "p6_found": f"select distinct track_id, frame_index, source_index from ({_NEAREST}) where source_index is not null",
}
