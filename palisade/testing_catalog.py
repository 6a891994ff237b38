"""Catalog and policies for the TPC-H-like tables that the registered queries run on, and short forms of a plan's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lower import Bindings
from .plans.catalog import Catalog
from .plans.policy import PolicySet
from .plans.validate import ValidatedPlan, validate
from .sources.tables import read_parquet

VERSION = "v1"
_KINDS = {"s": "string", "i": "integer", "f": "float", "d": "decimal", "b": "boolean", "t": "datetime"}

#: Fields as name:kind, a trailing ! for sensitive ones, * for spatial or temporal ones.
TABLES = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s! c_nationkey:i c_acctbal:d! c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s! s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t* o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d! l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t*",
    "events": "event_id:i ts:t* user_id:i event_type:s! value:f props:s",
    "customer_places": "c_custkey:i c_name:s! c_lat:f* c_lon:f*",
    "supplier_places": "s_suppkey:i s_name:s! s_lat:f* s_lon:f*",
}
#: Digits of decimals, two of them behind the point.
DIGITS = {"lineitem": {"l_quantity": 6, "l_extendedprice": 9, "l_discount": 3, "l_tax": 3}}
_TEMPORAL = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
_SPATIAL = {"customer_places": ("c_lat", "c_lon"), "supplier_places": ("s_lat", "s_lon")}


def _field(spec: str) -> dict:
    name, kind = spec.split(":")
    roles = [] if "*" not in kind else ["temporal"] if kind[0] == "t" else ["spatial"]
    return {"name": name, "data_type": _KINDS[kind[0]], "nullable": True, "roles": roles, "sensitive": "!" in kind}


def catalog() -> Catalog:
    return Catalog.read(
        {
            "datasets": [
                {
                    "dataset_id": name,
                    "versions": [VERSION],
                    "default_version": VERSION,
                    "fields": [_field(f) for f in fields.split()],
                    "temporal_field": _TEMPORAL.get(name),
                    "spatial": None if name not in _SPATIAL else dict(zip(("latitude_field", "longitude_field", "crs"), (*_SPATIAL[name], "EPSG:4326"), strict=True)),
                }
                for name, fields in TABLES.items()
            ]
        }
    )


def policies(*obligations: dict) -> PolicySet:
    """One rule that lets analysts research all tables under ``obligations``."""
    rule = {
        "policy_id": "analysts",
        "policy_version": "1",
        "subject_roles": ["analyst"],
        "purposes": ["research"],
        "actions": ["read", "join", "aggregate"],
        "resources": sorted(TABLES),
        "decision": "PERMIT",
        "obligations": [{"obligation_type": "VERSION_PIN"}, *obligations],
        "reason": "research on shared tables",
    }
    return PolicySet.read({"policy_set_id": "shared", "policy_snapshot": "p1", "rules": [rule]})


def places(df: DataFrame, key: str, lat: str, lon: str, step: tuple[int, int]) -> DataFrame:
    """Coordinates made from a key, as the tables have none."""
    k = F.col(key)
    return df.withColumns({lat: F.lit(-60.0) + (k * step[0] % 1200) / F.lit(10.0), lon: F.lit(-180.0) + (k * step[1] % 3600) / F.lit(10.0)})


def bindings(spark: SparkSession, sf_dir: str) -> Bindings:
    read = lambda name: read_parquet(spark, f"{sf_dir}/{name}.parquet")
    tables: dict = {name: f"{sf_dir}/{name}.parquet" for name in TABLES if not name.endswith("_places")}
    tables["customer_places"] = lambda: places(read("customer"), "c_custkey", "c_lat", "c_lon", (37, 91))
    tables["supplier_places"] = lambda: places(read("supplier"), "s_suppkey", "s_lat", "s_lon", (53, 17))
    return Bindings(spark, tables, catalog(), DIGITS)


def scan(dataset: str, **more) -> dict:
    return {"operator_type": "ScanSource", "dataset": dataset, **more}


def op(kind: str, **more) -> dict:
    return {"operator_type": kind, **more}


def compare(field: str, operator: str, data_type: str, value, negated: bool = False) -> dict:
    return {
        "expression_type": "comparison",
        "operator": operator,
        "left": {"expression_type": "field", "field": field},
        "right": {"expression_type": "literal", "data_type": data_type, "value": value},
        "negated": negated,
    }


def request(operators: list[dict], fields: list[str] | None = None, action: str = "read") -> dict:
    """A candidate plan: operators in order, each with the one before it as input unless it names its own."""
    for i, op in enumerate(operators):
        op.setdefault("operator_id", f"op-{i}")
        if op["operator_type"] != "ScanSource":
            op.setdefault("inputs", [operators[i - 1]["operator_id"]])
    return {
        "plan_id": "registered",
        "request_context": {"subject": {"subject_id": "a", "role": "analyst"}, "purpose": "research", "action": action},
        "requested_output": {"fields": fields or []},
        "operators": operators,
        "output_operator": operators[-1]["operator_id"],
    }


def validated(operators: list[dict], *obligations: dict, fields: list[str] | None = None) -> ValidatedPlan:
    response = validate(request(operators, fields), policies(*obligations), catalog())
    if response.validated_plan is None:
        raise ValueError(response.codes)
    return response.validated_plan
