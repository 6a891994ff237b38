"""Fixed query shapes with several result-equal ways to run them.

``events`` has row_id, sensitive_value, join_key, query_bucket; ``dimension`` has dimension_key, marker.  A policy keeps rows whose
sensitive value hashes below a cutoff, a query keeps a share of buckets, and the value is masked.  Ways differ in what is
stored on the way, and raw values are stored only in the ways that say so.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import planar_km
from ..plans.choice import Exposure
from ..sources.tables import bucket_of, hash_of, stored


def _policy(df: DataFrame, cutoff: int) -> DataFrame:
    return df.where(bucket_of(F.col("sensitive_value")) < cutoff)


def _query(df: DataFrame, cutoff: int) -> DataFrame:
    return df.where(F.col("query_bucket") < cutoff)


def _masked(df: DataFrame) -> DataFrame:
    return df.withColumn("sensitive_value", F.md5("sensitive_value"))


def _joined(events: DataFrame, dimension: DataFrame) -> DataFrame:
    return events.join(dimension, events.join_key == dimension.dimension_key).select("row_id", "sensitive_value", "marker")


# ---------------------------------------------------------------- governed pipeline


def fused(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    return _joined(_masked(_query(_policy(events, policy), query)), dimension)


def policy_first(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    """Stores what the policy allows, masked."""
    return _joined(_query(stored(_masked(_policy(events, policy)), "policy"), query), dimension)


def query_first(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    """Stores what the query asks for, raw."""
    return _joined(_masked(_policy(stored(_query(events, query), "query"), policy)), dimension)


def join_first(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    """Stores the allowed rows with their dimension, masked."""
    allowed = _masked(_policy(events, policy))
    wide = stored(allowed.join(dimension, allowed.join_key == dimension.dimension_key), "join")
    return _query(wide, query).select("row_id", "sensitive_value", "marker")


PIPELINES: dict[str, Callable[..., DataFrame]] = {
    "fused_governed": fused,
    "policy_first_masked_checkpoint": policy_first,
    "query_first_raw_checkpoint": query_first,
    "join_first_masked_checkpoint": join_first,
}


def pipeline_exposure(name: str, rows: int, policy_share: float, query_share: float) -> Exposure:
    """What a way shows, from row counts and shares."""
    allowed, asked = round(rows * policy_share), round(rows * query_share)
    return {
        "fused_governed": Exposure(checkpoint=False),
        "policy_first_masked_checkpoint": Exposure(masked_stored_rows=allowed),
        "query_first_raw_checkpoint": Exposure(raw_stored_rows=asked),
        "join_first_masked_checkpoint": Exposure(masked_stored_rows=allowed),
    }[name]


def _wide_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(38,0)"))


def totals(rows: DataFrame) -> DataFrame:
    """Count and sums of a pipeline's rows, as exact wide integers."""
    return rows.agg(F.count(F.lit(1)).alias("row_count"), _wide_sum("row_id").alias("row_id_sum"), _wide_sum("marker").alias("marker_sum"))


# ---------------------------------------------------------------- governed totals over a checkpoint


def _totals_of(events: DataFrame, dimension: DataFrame) -> DataFrame:
    return totals(events.join(dimension, events.join_key == dimension.dimension_key).select("row_id", "marker"))


def totals_fused(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    return _totals_of(_query(_policy(events, policy), query), dimension)


def totals_policy_first(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    """Stores what the policy allows, without the sensitive value."""
    return _totals_of(_query(stored(_policy(events, policy).select("row_id", "join_key", "query_bucket"), "policy-totals"), query), dimension)


def totals_query_first(events: DataFrame, dimension: DataFrame, policy: int, query: int) -> DataFrame:
    """Stores what the query asks for, raw."""
    return _totals_of(_policy(stored(_query(events, query).select("row_id", "join_key", "sensitive_value"), "query-totals"), policy), dimension)


TOTALS: dict[str, Callable[..., DataFrame]] = {
    "fused_governed_pipeline": totals_fused,
    "policy_first": totals_policy_first,
    "query_first": totals_query_first,
}


# ---------------------------------------------------------------- join and aggregate


def join_then_aggregate(events: DataFrame, dimension: DataFrame, policy: int) -> DataFrame:
    allowed = _policy(events, policy)
    return allowed.join(dimension, allowed.join_key == dimension.dimension_key).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def partial_aggregate_then_join(events: DataFrame, dimension: DataFrame, policy: int) -> DataFrame:
    """Counts by key first: the join then moves a row per key, however hot a key is."""
    counts = _policy(events, policy).groupBy("join_key").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(dimension, counts.join_key == dimension.dimension_key).groupBy("marker").agg(F.sum("k").alias("n"))


# ---------------------------------------------------------------- lineage for batches of queries


def _identity(df: DataFrame) -> DataFrame:
    return df.withColumn("source_id", F.sha2(F.col("event_id"), 256))


def _answer(df: DataFrame, policy: int, query: int, number: int) -> DataFrame:
    kept = df.where((F.col("policy_bucket") < policy) & (F.col("query_bucket") < query))
    return kept.select(F.lit(number).alias("query_no"), "event_value", "source_id")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineage_late(events: DataFrame, cutoffs: list[tuple[int, int]]) -> DataFrame:
    """Each query hashes the rows that it returns."""
    return _all([_identity_after(events, p, q, i) for i, (p, q) in enumerate(cutoffs)])


def _identity_after(events: DataFrame, policy: int, query: int, number: int) -> DataFrame:
    kept = events.where((F.col("policy_bucket") < policy) & (F.col("query_bucket") < query))
    return _identity(kept).select(F.lit(number).alias("query_no"), "event_value", "source_id")


def lineage_policy_checkpoint(events: DataFrame, cutoffs: list[tuple[int, int]]) -> DataFrame:
    """Rows that any query's policy allows are hashed and stored once."""
    widest = max(p for p, _ in cutoffs)
    base = stored(_identity(events.where(F.col("policy_bucket") < widest)).drop("event_id"), "policy-lineage")
    return _all([_answer(base, p, q, i) for i, (p, q) in enumerate(cutoffs)])


def lineage_snapshot_checkpoint(events: DataFrame, cutoffs: list[tuple[int, int]]) -> DataFrame:
    """All rows are hashed and stored once."""
    base = stored(_identity(events).drop("event_id"), "snapshot-lineage")
    return _all([_answer(base, p, q, i) for i, (p, q) in enumerate(cutoffs)])


LINEAGE: dict[str, Callable[..., DataFrame]] = {
    "late_per_query_capture": lineage_late,
    "policy_lineage_checkpoint": lineage_policy_checkpoint,
    "snapshot_lineage_checkpoint": lineage_snapshot_checkpoint,
}


# ---------------------------------------------------------------- filters in any order, masks early or late


FILTERS = ("temporal", "spatial", "policy")
FILTER_ORDERS = tuple(itertools.permutations(FILTERS))
BOUNDARIES = (*FILTERS, "project")


def filters(start: Column, end: Column, centre: tuple[float, float], radius_km: float) -> dict[str, Column]:
    """The three filters of events (event_time, latitude, longitude, policy_allowed)."""
    return {
        "temporal": (F.col("event_time") >= start) & (F.col("event_time") < end),
        "spatial": planar_km(F.col("latitude"), F.col("longitude"), centre) <= F.lit(radius_km),
        "policy": F.col("policy_allowed"),
    }


def _labelled(df: DataFrame, dimension: DataFrame) -> DataFrame:
    joined = df.join(dimension, df.join_key == dimension.dimension_key)
    return joined.select("event_id", "severity_label").orderBy("event_id")


def filters_fused(df: DataFrame, dimension: DataFrame, by: dict[str, Column]) -> DataFrame:
    return filters_in_order(df, dimension, by, FILTERS, stages=False)


def filters_in_order(df: DataFrame, dimension: DataFrame, by: dict[str, Column], order: tuple[str, ...], stages: bool = True) -> DataFrame:
    """Filters one after another, each result stored (else Catalyst merges them), then the dimension's label, by event."""
    for name in order:
        df = df.where(by[name])
        if stages:
            df = stored(df, f"filter-{name}")
    return _labelled(df, dimension)


def filters_with_boundary(df: DataFrame, dimension: DataFrame, by: dict[str, Column], after: str) -> DataFrame:
    """The usual order with one stored result: after a filter, or after only the needed columns are left."""
    done = FILTERS if after == "project" else FILTERS[: FILTERS.index(after) + 1]
    for name in done:
        df = df.where(by[name])
    df = stored(df.select("event_id", "join_key") if after == "project" else df, f"boundary-{after}")
    for name in FILTERS[len(done) :]:
        df = df.where(by[name])
    return _labelled(df, dimension)


def mask_early(events: DataFrame, dimension: DataFrame) -> DataFrame:
    hidden = events.withColumn("sensitive_value", F.sha2("sensitive_value", 256))
    return hidden.join(dimension, hidden.join_key == dimension.dimension_key).select("row_id", "sensitive_value", "marker").orderBy("row_id")


def mask_late(events: DataFrame, dimension: DataFrame) -> DataFrame:
    joined = events.join(dimension, events.join_key == dimension.dimension_key)
    return joined.withColumn("sensitive_value", F.sha2("sensitive_value", 256)).select("row_id", "sensitive_value", "marker").orderBy("row_id")


def mask_aggregate(events: DataFrame) -> DataFrame:
    """Rows by masked value: the hash is taken once a group."""
    return events.groupBy("sensitive_value").agg(F.count(F.lit(1)).alias("n")).select(F.sha2("sensitive_value", 256).alias("sensitive_value"), "n")


# ---------------------------------------------------------------- flows of a sensitive value through a join

_Flow = Callable[[DataFrame, DataFrame], DataFrame]


def _matched(events: DataFrame, dimension: DataFrame, *columns: str) -> DataFrame:
    return events.join(dimension, events.join_key == dimension.dimension_key).select(*columns, "marker")


def _hidden(df: DataFrame) -> DataFrame:
    return df.withColumn("masked_value", F.sha2("sensitive_value", 256)).drop("sensitive_value")


def _counted(rows: DataFrame, length: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("result_rows"), _wide_sum("marker").alias("marker_sum"), F.sum(length.cast("decimal(38,0)")).alias("payload_length_sum"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("result_rows"), _wide_sum("marker").alias("marker_sum"), F.bit_xor(hash_of("masked_value")).alias("mask_digest"))


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "masked_value", "marker")


def _in_order(rows: DataFrame) -> DataFrame:
    return _rows(rows).orderBy("masked_value", "row_id")


def _before_join(end: Callable[[DataFrame], DataFrame], *columns: str) -> _Flow:
    """Masked values are stored, then joined."""
    return lambda events, dimension: end(_matched(stored(_hidden(events.select(*columns, "sensitive_value", "join_key")), "masked"), dimension, *columns, "masked_value"))


def _after_join(end: Callable[[DataFrame], DataFrame], *columns: str) -> _Flow:
    """Values are masked in the joined rows, and nothing is stored."""
    return lambda events, dimension: end(_hidden(_matched(events, dimension, *columns, "sensitive_value")))


def _raw_after_join(end: Callable[[DataFrame], DataFrame], *columns: str) -> _Flow:
    """Raw joined rows are stored, then masked."""
    return lambda events, dimension: end(_hidden(stored(_matched(events, dimension, *columns, "sensitive_value"), "raw")))


def flows(width: int) -> dict[str, dict[str, _Flow]]:
    """Groups of ways that give equal results; ``width`` is the length of every sensitive value, where a way doesn't read it."""

    def counted(rows: DataFrame) -> DataFrame:
        return _counted(rows, F.lit(width))

    return {
        "column_pruning": {
            "join_key_only_aggregate": lambda e, d: counted(_matched(e, d)),
            "dead_raw_projection_aggregate": lambda e, d: counted(_matched(e, d, "sensitive_value")),
            "raw_materialized_aggregate": lambda e, d: _counted(stored(_matched(e, d, "sensitive_value"), "raw"), F.length("sensitive_value")),
        },
        "mask_output": {
            "prejoin_mask_materialized_output": _before_join(_rows, "row_id"),
            "postjoin_mask_fused_output": _after_join(_rows, "row_id"),
            "postjoin_raw_materialized_mask_output": _raw_after_join(_rows, "row_id"),
        },
        "mask_aggregate": {
            "prejoin_mask_materialized_aggregate": _before_join(_digested),
            "postjoin_mask_fused_aggregate": _after_join(_digested),
            "postjoin_raw_materialized_mask_aggregate": _raw_after_join(_digested),
        },
        "mask_sorted_output": {
            "prejoin_mask_materialized_sorted_output": _before_join(_in_order, "row_id"),
            "postjoin_mask_fused_sorted_output": _after_join(_in_order, "row_id"),
        },
    }


# ---------------------------------------------------------------- one mechanism at a time


def components() -> dict[str, _Flow]:
    """Single mechanisms on events and a dimension, for measuring: a scan, a hash, a join's payload, a stored table, a masked fragment."""
    length = lambda c: F.sum(F.length(c).cast("decimal(38,0)")).alias("length_sum")
    keys = lambda d: d.select(F.col("dimension_key").alias("join_key")).distinct()
    narrow = lambda e: stored(e.select("row_id", "sensitive_value"), "narrow")
    return {
        "hash_scan": lambda e, d: e.agg(length("sensitive_value")),
        "hash_sha256": lambda e, d: e.agg(length(F.sha2("sensitive_value", 256))),
        "join_payload_baseline": lambda e, d: e.join(keys(d), "join_key", "left_semi").select("row_id", "sensitive_value", F.lit(0).cast("bigint").alias("marker")),
        "join_payload": lambda e, d: _matched(e, d, "row_id", "sensitive_value"),
        "materialization_write": lambda e, d: narrow(e),
        "materialization_read": lambda e, d: narrow(e).agg(F.count(F.lit(1)).alias("row_count"), length("sensitive_value")),
        "early_mask_fragment": _before_join(_in_order, "row_id"),
        "late_mask_fragment": _after_join(_in_order, "row_id"),
    }
