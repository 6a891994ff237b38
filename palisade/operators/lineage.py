"""Lineage evidence: source edges from the plan, record edges from the rows, and their verification.

Record edges stay a distributed table.  Four encodings name an edge: V1 by digests of canonical JSON, V2 by 32-byte digests
of tagged keys, V3 by digests that are hashed from the key's length and bytes inside the engine, and V4 by the row's
place in a sorted result.  Verification recomputes edges and compares the tables both ways.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..plans import graph, nodes
from ..plans.shapes import canonical
from ..plans.validate import ValidatedPlan
from ..sources.tables import places


class LineageRefused(Exception):
    """The evidence cannot be captured for this plan."""


def sha256(v) -> str:
    return "sha256:" + hashlib.sha256(canonical(v).encode()).hexdigest()


@dataclass(frozen=True)
class Evidence:
    execution_id: str
    result_id: str
    lineage_level: str
    covered_operators: tuple[str, ...]
    edge_digest: str


# ---------------------------------------------------------------- sources


def source_edges(plan: ValidatedPlan) -> list[dict[str, str]]:
    """An edge from each dataset version that a required target reads."""
    out = []
    for requirement in plan.lineage_requirements:
        if requirement.level != "source":
            raise LineageRefused("source edges do not meet a record requirement")
        known = plan.by_id()
        for name in sorted(graph.reachable(plan.operators, requirement.target_operator)):
            op = known[name]
            if isinstance(op, nodes.ScanSource):
                out.append({"dataset": op.dataset, "snapshot": plan.data_snapshots[op.dataset], "target_operator": requirement.target_operator})
    return sorted(out, key=lambda e: (e["dataset"], e["snapshot"], e["target_operator"]))


def capture_sources(plan: ValidatedPlan, execution_id: str, result_id: str) -> tuple[Evidence | None, str | None]:
    """Evidence and lineage digest; none if the plan requires none."""
    if not plan.lineage_requirements:
        return None, None
    edges = source_edges(plan)
    targets = tuple(dict.fromkeys(r.target_operator for r in plan.lineage_requirements))
    if {e["target_operator"] for e in edges} != set(targets):
        raise LineageRefused("a target has no source")
    body = {"execution_id": execution_id, "result_id": result_id, "logical_plan_digest": plan.canonical_digest, "edges": edges}
    return Evidence(execution_id, result_id, "source", targets, sha256(edges)), sha256(body)


# ---------------------------------------------------------------- records

_ROW_WISE = (nodes.ScanSource, nodes.Filter, nodes.SpatialFilter, nodes.TemporalFilter, nodes.Project, nodes.Sort, nodes.Mask, nodes.GeneralizeLocation)


def record_fragment(plan: ValidatedPlan, dataset: str, keys: tuple[str, ...]) -> str:
    """The captured operator, if rows there stem from one row of ``dataset`` each and carry its raw key."""
    targets = [r.target_operator for r in plan.lineage_requirements if r.level == "record"]
    if len(targets) != 1:
        raise LineageRefused("exactly one record requirement is needed")
    known = plan.by_id()
    fragment = [known[n] for n in graph.reachable(plan.operators, targets[0])]
    chain = [o for o in plan.operators if not isinstance(o, nodes.LineageCapture)]
    if other := sorted({o.operator_type for o in chain if not isinstance(o, _ROW_WISE)}):
        raise LineageRefused(f"rows are not followed through {', '.join(other)}")
    scans = [o for o in fragment if isinstance(o, nodes.ScanSource)]
    if len(scans) != 1 or scans[0].dataset != dataset:
        raise LineageRefused("rows are followed to exactly one dataset")
    if any(isinstance(o, nodes.Mask) and set(o.fields) & set(keys) for o in chain):
        raise LineageRefused("a masked field is no identity")
    if missing := set(keys) - {f.name for f in plan.output_schema}:
        raise LineageRefused(f"the output lacks {', '.join(sorted(missing))}")
    return targets[0]


def lower_for_records(plan: ValidatedPlan, bindings) -> DataFrame:
    """The plan's rows; its record marker is a pass-through."""
    from .lower import lower

    operators = tuple(o.with_(level="source") if isinstance(o, nodes.LineageCapture) else o for o in plan.operators)
    return lower(plan, bindings, operators=operators)


def check_keys(result: DataFrame, keys: tuple[str, ...]) -> None:
    """Keys must be there and unique, in one aggregation."""
    null = F.max(F.greatest(*[column(k).isNull() for k in keys], F.lit(False)).cast("int")).alias("null")
    row = result.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("n"), null).agg(F.max("n").alias("n"), F.max("null").alias("null")).first()
    if row["null"]:
        raise LineageRefused("an identity is null")
    if (row["n"] or 1) > 1:
        raise LineageRefused("an identity is not unique")


def _json_string(c: Column) -> Column:
    """A JSON value, as the canonical writer writes it."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", "$1")


def _context(plan: ValidatedPlan, dataset: str, keys: tuple[str, ...]) -> dict:
    return {"dataset": dataset, "snapshot": plan.data_snapshots[dataset], "columns": list(keys)}


def edges_v1(result: DataFrame, plan: ValidatedPlan, dataset: str, keys: tuple[str, ...], result_id: str) -> DataFrame:
    """``output_record_id``, ``source_dataset``, ``source_snapshot``, ``source_record_id``: digests of sorted compact JSON."""
    snapshot = plan.data_snapshots[dataset]
    values = F.concat(F.lit("["), F.concat_ws(",", *[_json_string(column(k)) for k in keys]), F.lit("]"))
    key = F.concat(F.lit('{"columns":' + json.dumps(list(keys), separators=(",", ":")) + ',"values":'), values, F.lit("}"))
    output = F.concat(F.lit('{"output_key":'), key, F.lit(',"result_id":' + json.dumps(result_id) + "}"))
    source = F.concat(F.lit('{"dataset":' + json.dumps(dataset) + ',"snapshot":' + json.dumps(snapshot) + ',"source_key":'), key, F.lit("}"))
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    return result.select(
        digest(output).alias("output_record_id"), F.lit(dataset).alias("source_dataset"), F.lit(snapshot).alias("source_snapshot"), digest(source).alias("source_record_id")
    )


def edges_v2(result: DataFrame, plan: ValidatedPlan, dataset: str, keys: tuple[str, ...], result_id: str) -> DataFrame:
    """``output_id``, ``source_id``: 32 bytes each; a type tag keeps the string "1" from the number 1."""
    source = hashlib.sha256(canonical(_context(plan, dataset, keys)).encode()).digest()
    output = hashlib.sha256(result_id.encode()).digest()
    tags = dict(result.dtypes)
    key = F.to_binary(F.concat_ws(",", *[F.concat(F.lit(f'{{"type":"{tags[k]}","value":'), _json_string(column(k)), F.lit("}")) for k in keys]), F.lit("utf-8"))
    name = lambda tag, context: F.unhex(F.sha2(F.concat(F.lit(tag + context), key), 256))
    return result.select(name(b"O", output).alias("output_id"), name(b"S", source).alias("source_id"))


def _hashed(prefix: str, key: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(prefix), F.octet_length(key).cast("string"), F.lit(":"), key), 256))


def edges_v3(result: DataFrame, plan: ValidatedPlan, dataset: str, keys: tuple[str, ...], result_id: str) -> DataFrame:
    """As V2 for one string key, hashed from length and bytes by built-in functions."""
    (key,) = keys
    if dict(result.dtypes)[key] != "string":
        raise LineageRefused("the key must be one string")
    source = f"source|{dataset}|{plan.data_snapshots[dataset]}|{key}|"
    output = f"output|{plan.canonical_digest}|{key}|"
    return result.select(_hashed(output, column(key)).alias("output_id"), _hashed(source, column(key)).alias("source_id"))


def edges_v4(result: DataFrame, plan: ValidatedPlan, dataset: str, keys: tuple[str, ...], result_id: str) -> DataFrame:
    """``ordinal``, ``source_id``: 32 bytes for each place of a sorted result.

    The order is the plan's, so the plan must sort, by keys that leave no ties.  The sorted rows are stored once and numbered there: rows of
    earlier partitions, plus the place in the own one.
    """
    if not any(isinstance(o, nodes.Sort) for o in plan.operators):
        raise LineageRefused("a place needs an order")
    (key,) = keys
    source = f"source|{dataset}|{plan.data_snapshots[dataset]}|{key}|"
    placed = places(result.select(_hashed(source, column(key).cast("string")).alias("source_id")), "ordinal")
    return placed.select(F.col("ordinal").cast("long").alias("ordinal"), "source_id")


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Edges of either table that the other lacks, with multiplicity; none if the evidence holds."""
    cols = recomputed.columns
    a = stored.select(*cols).withColumn("_side", F.lit(1))
    b = recomputed.select(*cols).withColumn("_side", F.lit(-1))
    return a.unionByName(b).groupBy(*cols).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")


def verify_records(stored: DataFrame, recomputed: DataFrame) -> bool:
    return differences(stored, recomputed).isEmpty()


# ---------------------------------------------------------------- result digests


def row_json(df: DataFrame) -> Column:
    """A row as JSON with decimals and times as strings and null fields kept."""
    text = lambda f: column(f.name).cast("string") if f.dataType.typeName() in ("decimal", "timestamp", "timestamp_ntz", "date") else column(f.name)
    return F.to_json(F.array(F.struct(*[text(f).alias(f.name) for f in df.schema.fields])), {"ignoreNullFields": "false"})


def unordered_digest(df: DataFrame) -> str:
    """The same for the same rows in any order: the rows' digests are summed in parts, nothing is collected."""
    h = F.sha2(row_json(df), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return sha256({"columns": df.columns, "rows": row["n"], "sums": [str(row[f"s{i}"]) for i in range(4)]})


def ordered_digest(columns: list[str], rows: list[tuple]) -> str:
    """Digest of rows that a client holds, in their order."""
    from decimal import Decimal

    value = lambda v: str(v) if isinstance(v, Decimal) else v.isoformat() if hasattr(v, "isoformat") else v
    return sha256({"columns": columns, "rows": [[value(v) for v in r] for r in rows]})
