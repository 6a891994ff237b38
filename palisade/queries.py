"""The registered queries of the engine and the SQL that gives the same rows.

Most are plans that go through validation and lowering like a client's.  Decimals leave as doubles of their exact value.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import explain, families, lineage
from .operators.lower import conform, lower
from .plans.validate import ValidatedPlan
from .sources import tables
from .testing_catalog import bindings, catalog, compare, op, scan, validated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _flat(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines' results have one type."""
    return df.select(*[F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields])


def plan(name: str, operators: Callable[[], list[dict]], sql: str, *obligations: dict, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Register a plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(shape(lower(validated(operators(), *obligations), bindings(spark, sf_dir))))

    QUERIES[name] = run
    SQL[name] = sql


def direct(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a function of the tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def group(operator: str, *operands: dict, negated: bool = False) -> dict:
    return {"expression_type": "boolean", "operator": operator, "operands": list(operands), "negated": negated}


def keep(*fields: str) -> dict:
    return op("Project", fields=list(fields))


def agg(function: str, output: str, field: str | None = None, expression: dict | None = None) -> dict:
    return {"function": function, "output_field": output, **({"input_field": field} if field else {}), **({"input_expression": expression} if expression else {})}


def ref(field: str) -> dict:
    return {"expression_type": "field", "field": field}


def one(sign: str, field: str) -> dict:
    return {"expression_type": "numeric_affine", "constant": {"expression_type": "literal", "data_type": "decimal", "value": "1"}, "operator": sign, "field": ref(field)}


def formula(*factors: dict) -> dict:
    return {"expression_type": "numeric_product_formula", "factors": list(factors)}


def rounded(**places_: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, n) for c, n in places_.items()})


YEAR = op("TemporalFilter", field="l_shipdate", start="1996-01-01T00:00:00Z", end="1997-01-01T00:00:00Z")
IN_1996 = "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'"

# ---------------------------------------------------------------- benchmark queries

plan(
    "q1",
    lambda: [
        scan("lineitem"),
        op("TemporalFilter", field="l_shipdate", start="1900-01-01T00:00:00Z", end="2001-09-03T00:00:00Z"),
        op(
            "Aggregate",
            group_by=["l_returnflag", "l_linestatus"],
            aggregates=[
                agg("sum", "sum_qty", "l_quantity"),
                agg("sum", "sum_base_price", "l_extendedprice"),
                agg("sum", "sum_disc_price", expression=formula(ref("l_extendedprice"), one("subtract", "l_discount"))),
                agg("sum", "sum_charge", expression=formula(ref("l_extendedprice"), one("subtract", "l_discount"), one("add", "l_tax"))),
                agg("avg", "avg_qty", "l_quantity"),
                agg("avg", "avg_price", "l_extendedprice"),
                agg("avg", "avg_disc", "l_discount"),
                agg("count", "count_order"),
            ],
        ),
        op("Sort", keys=[{"field": "l_returnflag"}, {"field": "l_linestatus"}]),
    ],
    """
SELECT l_returnflag, l_linestatus, sum(q)::DOUBLE AS sum_qty, sum(p)::DOUBLE AS sum_base_price, round(sum(p * (1 - d))::DOUBLE, 4) AS sum_disc_price,
       round(sum(p * (1 - d) * (1 + t))::DOUBLE, 4) AS sum_charge, round(avg(q::DOUBLE), 6) AS avg_qty, round(avg(p::DOUBLE), 4) AS avg_price,
       round(avg(d::DOUBLE), 6) AS avg_disc, count(*) AS count_order
FROM (SELECT l_returnflag, l_linestatus, l_shipdate, CAST(l_quantity AS DECIMAL(15,2)) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS p,
             CAST(l_discount AS DECIMAL(15,2)) AS d, CAST(l_tax AS DECIMAL(15,2)) AS t FROM lineitem)
WHERE l_shipdate < TIMESTAMP '2001-09-03' GROUP BY l_returnflag, l_linestatus
""",
    shape=lambda df: rounded(sum_disc_price=4, sum_charge=4, avg_qty=6, avg_price=4, avg_disc=6)(_flat(df)),
)

plan(
    "q3",
    lambda: [
        scan("customer", operator_id="c"),
        op("Filter", operator_id="cf", inputs=["c"], expression=compare("c_mktsegment", "eq", "string", "BUILDING")),
        scan("orders", operator_id="o"),
        op("TemporalFilter", operator_id="of", inputs=["o"], field="o_orderdate", start="1900-01-01T00:00:00Z", end="1998-03-15T00:00:00Z"),
        scan("lineitem", operator_id="l"),
        op("TemporalFilter", operator_id="lf", inputs=["l"], field="l_shipdate", start="1998-03-16T00:00:00Z", end="2100-01-01T00:00:00Z"),
        op("Join", operator_id="co", inputs=["cf", "of"], left_field="c_custkey", right_field="o_custkey"),
        op("Join", operator_id="col", inputs=["lf", "co"], left_field="l_orderkey", right_field="o_orderkey"),
        op("Aggregate", operator_id="a", group_by=["l_orderkey"], aggregates=[agg("sum", "revenue", expression=formula(ref("l_extendedprice"), one("subtract", "l_discount"))), agg("count", "n_lines")]),
        op("Sort", operator_id="s", keys=[{"field": "revenue", "direction": "desc"}, {"field": "l_orderkey"}]),
        op("Limit", operator_id="t", row_count=10),
    ],
    """
SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))::DOUBLE AS revenue, count(*) AS n_lines
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate >= TIMESTAMP '1998-03-16'
GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10
""",
)

plan(
    "q6",
    lambda: [
        scan("lineitem"),
        YEAR,
        op(
            "Filter",
            expression=group("and", compare("l_discount", "ge", "decimal", "0.05"), compare("l_discount", "le", "decimal", "0.07"), compare("l_quantity", "lt", "decimal", "24")),
        ),
        op("Aggregate", group_by=[], aggregates=[agg("sum", "revenue", expression={"expression_type": "numeric_product", "left": ref("l_extendedprice"), "right": ref("l_discount")})]),
    ],
    f"""
SELECT sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)))::DOUBLE AS revenue FROM lineitem
WHERE {IN_1996} AND CAST(l_discount AS DECIMAL(15,2)) BETWEEN 0.05 AND 0.07 AND CAST(l_quantity AS DECIMAL(15,2)) < 24
""",
)

plan(
    "q10",
    lambda: [
        scan("orders", operator_id="o"),
        op("TemporalFilter", operator_id="of", inputs=["o"], field="o_orderdate", start="1996-01-01T00:00:00Z", end="1996-04-01T00:00:00Z"),
        scan("customer", operator_id="c"),
        scan("nation", operator_id="n"),
        scan("lineitem", operator_id="l"),
        op("Filter", operator_id="lf", inputs=["l"], expression=compare("l_returnflag", "eq", "string", "R")),
        op("Join", operator_id="cn", inputs=["c", "n"], left_field="c_nationkey", right_field="n_nationkey"),
        op("Join", operator_id="oc", inputs=["of", "cn"], left_field="o_custkey", right_field="c_custkey"),
        op("Join", operator_id="ol", inputs=["lf", "oc"], left_field="l_orderkey", right_field="o_orderkey"),
        op("Aggregate", operator_id="a", group_by=["c_custkey", "c_name", "n_name"], aggregates=[agg("sum", "revenue", expression=formula(ref("l_extendedprice"), one("subtract", "l_discount")))]),
        op("Sort", operator_id="s", keys=[{"field": "revenue", "direction": "desc"}, {"field": "c_custkey"}]),
        op("Limit", operator_id="t", row_count=20),
    ],
    """
SELECT c_custkey, c_name, n_name, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))::DOUBLE AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND l_returnflag = 'R'
GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20
""",
)

# ---------------------------------------------------------------- single operators

plan("scan", lambda: [scan("nation")], "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
plan("project", lambda: [scan("part"), keep("p_partkey", "p_brand")], "SELECT p_partkey, p_brand FROM part")
for _name, _sign in {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    plan(
        f"cmp_{_name}",
        lambda _name=_name: [scan("part"), op("Filter", expression=compare("p_size", _name, "integer", 25)), keep("p_partkey", "p_size")],
        f"SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size {_sign} 25",
    )
plan(
    "cmp_negated",
    lambda: [scan("orders"), op("Filter", expression=compare("o_orderstatus", "eq", "string", "F", negated=True)), keep("o_orderkey", "o_orderstatus")],
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_orderstatus = 'F'",
)
plan(
    "filter_and",
    lambda: [scan("lineitem"), op("Filter", expression=group("and", compare("l_quantity", "lt", "integer", 10), compare("l_returnflag", "eq", "string", "A"))), keep("l_orderkey", "l_linenumber")],
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'A'",
)
plan(
    "filter_or_negated",
    lambda: [
        scan("lineitem"),
        op("Filter", expression=group("or", compare("l_quantity", "lt", "decimal", "45"), compare("l_returnflag", "ne", "string", "R"), negated=True)),
        keep("l_orderkey", "l_linenumber", "l_quantity"),
    ],
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE NOT (l_quantity < 45 OR l_returnflag <> 'R')",
)
plan(
    "temporal_filter",
    lambda: [scan("orders"), op("TemporalFilter", field="o_orderdate", start="1997-02-01T00:00:00Z", end="1997-03-01T01:00:00+01:00"), keep("o_orderkey")],
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'",
)
plan(
    "temporal_comparison",
    lambda: [scan("orders"), op("Filter", expression=compare("o_orderdate", "ge", "datetime", "2000-01-01T00:00:00Z")), keep("o_orderkey")],
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
)
plan(
    "join_inner",
    lambda: [
        scan("orders", operator_id="o"),
        scan("customer", operator_id="c"),
        op("Join", operator_id="j", inputs=["o", "c"], left_field="o_custkey", right_field="c_custkey"),
        op("Project", operator_id="p", fields=["o_orderkey", "c_custkey", "c_mktsegment"]),
    ],
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
plan(
    "join_left",
    lambda: [
        scan("orders", operator_id="o"),
        scan("customer", operator_id="c"),
        op("Filter", operator_id="f", inputs=["c"], expression=compare("c_mktsegment", "eq", "string", "BUILDING")),
        op("Join", operator_id="j", inputs=["o", "f"], left_field="o_custkey", right_field="c_custkey", join_type="left"),
        op("Project", operator_id="p", fields=["o_orderkey", "c_custkey", "c_mktsegment"]),
    ],
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey",
)
plan(
    "sort_topk",
    lambda: [scan("orders"), keep("o_orderkey", "o_totalprice"), op("Sort", keys=[{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey"}]), op("Limit", row_count=50)],
    "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2))::DOUBLE AS o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 50",
)
plan(
    "sort",
    lambda: [scan("supplier"), keep("s_suppkey", "s_nationkey"), op("Sort", keys=[{"field": "s_nationkey"}, {"field": "s_suppkey", "direction": "desc"}])],
    "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier ORDER BY 2, 1 DESC",
)
plan("agg_count", lambda: [scan("events"), op("Aggregate", group_by=["event_type"], aggregates=[agg("count", "n")])], "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
plan(
    "agg_sum",
    lambda: [scan("lineitem"), op("Aggregate", group_by=["l_suppkey"], aggregates=[agg("sum", "qty", "l_quantity"), agg("sum", "lines", "l_linenumber")])],
    "SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(15,2)))::DOUBLE AS qty, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1",
)
plan(
    "agg_avg",
    lambda: [scan("lineitem"), op("Aggregate", group_by=["l_returnflag"], aggregates=[agg("avg", "avg_price", "l_extendedprice"), agg("avg", "avg_line", "l_linenumber")])],
    "SELECT l_returnflag, round(avg(CAST(l_extendedprice AS DECIMAL(15,2))::DOUBLE), 4) AS avg_price, round(avg(l_linenumber), 6) AS avg_line FROM lineitem GROUP BY 1",
    shape=rounded(avg_price=4, avg_line=6),
)
plan(
    "agg_min_max",
    lambda: [
        scan("orders"),
        op("Aggregate", group_by=["o_orderpriority"], aggregates=[agg("min", "low", "o_totalprice"), agg("max", "high", "o_totalprice"), agg("min", "first", "o_orderdate"), agg("max", "last", "o_orderdate")]),
    ],
    """SELECT o_orderpriority, min(CAST(o_totalprice AS DECIMAL(15,2)))::DOUBLE AS low, max(CAST(o_totalprice AS DECIMAL(15,2)))::DOUBLE AS high,
       epoch_us(min(o_orderdate)) AS first, epoch_us(max(o_orderdate)) AS last FROM orders GROUP BY 1""",
    shape=lambda df: df.withColumns({c: F.unix_micros(c) for c in ("first", "last")}),
)
plan(
    "agg_product",
    lambda: [
        scan("lineitem"),
        op("Aggregate", group_by=["l_linestatus"], aggregates=[agg("sum", "discounts", expression={"expression_type": "numeric_product", "left": ref("l_extendedprice"), "right": ref("l_discount")})]),
    ],
    "SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)))::DOUBLE AS discounts FROM lineitem GROUP BY 1",
)
plan(
    "agg_formula",
    lambda: [
        scan("lineitem"),
        op(
            "Aggregate",
            group_by=["l_returnflag"],
            aggregates=[
                agg("sum", "charge", expression=formula(ref("l_extendedprice"), one("subtract", "l_discount"), one("add", "l_tax"))),
                agg("avg", "avg_net", expression=formula(ref("l_quantity"), one("subtract", "l_discount"))),
            ],
        ),
    ],
    """SELECT l_returnflag, round(sum(p * (1 - d) * (1 + t))::DOUBLE, 4) AS charge, round(avg((q * (1 - d))::DOUBLE), 6) AS avg_net
FROM (SELECT l_returnflag, CAST(l_quantity AS DECIMAL(15,2)) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS p, CAST(l_discount AS DECIMAL(15,2)) AS d, CAST(l_tax AS DECIMAL(15,2)) AS t FROM lineitem)
GROUP BY 1""",
    shape=lambda df: rounded(charge=4, avg_net=6)(_flat(df)),
)
plan("mask_redact", lambda: [scan("customer"), keep("c_custkey", "c_name"), op("Mask", fields=["c_name"])], "SELECT c_custkey, '[REDACTED]' AS c_name FROM customer")
plan("mask_hash", lambda: [scan("customer"), keep("c_custkey", "c_name"), op("Mask", fields=["c_name"], method="hash")], "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
plan(
    "mask_null",
    lambda: [scan("customer"), keep("c_custkey", "c_acctbal", "c_name"), op("Mask", fields=["c_acctbal"], method="null")],
    "SELECT c_custkey, NULL::DOUBLE AS c_acctbal, c_name FROM customer",
)
plan(
    "mask_by_policy",
    lambda: [scan("customer"), op("Filter", expression=compare("c_mktsegment", "ne", "string", "BUILDING")), keep("c_custkey", "c_name", "c_mktsegment")],
    "SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    {"obligation_type": "MASK", "parameters": {"fields": ["c_name"], "method": "hash"}},
)
plan(
    "min_group_size",
    lambda: [scan("lineitem"), op("Aggregate", group_by=["l_partkey"], aggregates=[agg("sum", "qty", "l_quantity")])],
    "SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(15,2)))::DOUBLE AS qty FROM lineitem GROUP BY 1 HAVING count(*) >= 30",
    {"obligation_type": "MIN_GROUP_SIZE", "parameters": {"minimum_count": 20}},
    {"obligation_type": "MIN_GROUP_SIZE", "parameters": {"minimum_count": 30}},
)
plan(
    "lineage_source",
    lambda: [scan("supplier"), keep("s_suppkey", "s_nationkey")],
    "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier",
    {"obligation_type": "LINEAGE_CAPTURE", "parameters": {"level": "source"}},
)

# ---------------------------------------------------------------- space

_PLACES = {
    "c": "(SELECT c_custkey, c_name, -60.0 + (c_custkey * 37 % 1200) / 10.0 AS c_lat, -180.0 + (c_custkey * 91 % 3600) / 10.0 AS c_lon FROM customer)",
    "s": "(SELECT s_suppkey, s_name, -60.0 + (s_suppkey * 53 % 1200) / 10.0 AS s_lat, -180.0 + (s_suppkey * 17 % 3600) / 10.0 AS s_lon FROM supplier)",
}
_PLACES = {k: v.replace("-60.0", "-60.0::DOUBLE").replace("-180.0", "-180.0::DOUBLE").replace("/ 10.0", "/ 10.0::DOUBLE") for k, v in _PLACES.items()}
plan(
    "spatial_filter",
    lambda: [scan("customer_places"), op("SpatialFilter", center=[10.0, 20.0], radius_km=2500), keep("c_custkey")],
    f"SELECT c_custkey FROM {_PLACES['c']} WHERE 111.045 * sqrt(pow(c_lat - 10.0, 2) + pow((c_lon - 20.0) * cos(radians(10.0)), 2)) <= 2500",
)
plan(
    "spatial_join_within",
    lambda: [
        scan("customer_places", operator_id="c"),
        scan("supplier_places", operator_id="s"),
        op("SpatialJoin", operator_id="j", inputs=["c", "s"], relation="distance_within", left_fields=["c_lat", "c_lon"], right_fields=["s_lat", "s_lon"], distance_km=800),
        op("Project", operator_id="p", fields=["c_custkey", "s_suppkey"]),
    ],
    f"""SELECT c_custkey, s_suppkey FROM {_PLACES['c']} c JOIN {_PLACES['s']} s ON 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s_lat - c_lat) / 2), 2)
       + cos(radians(c_lat)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - c_lon) / 2), 2)))) <= 800""",
)
plan(
    "generalize_grid",
    lambda: [scan("customer_places"), keep("c_custkey", "c_lat", "c_lon")],
    f"""SELECT c_custkey, round(floor((c_lat + 90) / (50.0::DOUBLE / 111.045)) * (50.0::DOUBLE / 111.045) - 90 + 50.0::DOUBLE / 111.045 / 2, 9) AS c_lat,
       round(floor((c_lon + 180) / (50.0::DOUBLE / 111.045)) * (50.0::DOUBLE / 111.045) - 180 + 50.0::DOUBLE / 111.045 / 2, 9) AS c_lon FROM {_PLACES['c']}""",
    {"obligation_type": "GENERALIZE_LOCATION", "parameters": {"fields": ["c_lat", "c_lon"], "precision_km": 50}},
    shape=rounded(c_lat=9, c_lon=9),
)

# ---------------------------------------------------------------- record lineage


def _records_plan() -> ValidatedPlan:
    ops = [scan("customer"), op("Filter", expression=compare("c_mktsegment", "eq", "string", "BUILDING")), keep("c_custkey", "c_name")]
    return validated(ops, {"obligation_type": "LINEAGE_CAPTURE", "parameters": {"level": "record"}})


def _records(encode) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _records_plan()
        lineage.record_fragment(made, "customer", ("c_name",))
        rows = lineage.lower_for_records(made, bindings(spark, sf_dir))
        edges = encode(rows, made, "customer", ("c_name",), "result-1")
        return edges.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in edges.dtypes])

    return run


_BUILDING = "FROM customer WHERE c_mktsegment = 'BUILDING'"
_KEY_JSON = """'{"columns":["c_name"],"values":["' || c_name || '"]}'"""
direct(
    "lineage_v1",
    f"""SELECT 'sha256:' || sha256('{{"output_key":' || {_KEY_JSON} || ',"result_id":"result-1"}}') AS output_record_id, 'customer' AS source_dataset, 'v1' AS source_snapshot,
       'sha256:' || sha256('{{"dataset":"customer","snapshot":"v1","source_key":' || {_KEY_JSON} || '}}') AS source_record_id {_BUILDING}""",
)(_records(lineage.edges_v1))


def _constants() -> dict[str, str]:
    """What the identities of this plan's rows are hashed with, in hex or as text."""
    made = _records_plan()
    source = hashlib.sha256(lineage.canonical(lineage._context(made, "customer", ("c_name",))).encode()).hexdigest()
    return {"source": source, "output": hashlib.sha256(b"result-1").hexdigest(), "plan": made.canonical_digest}


_IDS = _constants()
_KEY_TYPED = """encode('{"type":"string","value":"' || c_name || '"}')"""
direct(
    "lineage_v2",
    f"""SELECT sha256(unhex('{b"O".hex()}{_IDS["output"]}') || {_KEY_TYPED}) AS output_id, sha256(unhex('{b"S".hex()}{_IDS["source"]}') || {_KEY_TYPED}) AS source_id {_BUILDING}""",
)(_records(lineage.edges_v2))
_KEY_SIZED = "strlen(c_name) || ':' || c_name"
direct(
    "lineage_v3",
    f"""SELECT sha256('output|{_IDS["plan"]}|c_name|' || {_KEY_SIZED}) AS output_id, sha256('source|customer|v1|c_name|' || {_KEY_SIZED}) AS source_id {_BUILDING}""",
)(_records(lineage.edges_v3))


@direct(
    "lineage_v4",
    "SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS ordinal, sha256('source|events|v1|event_id|' || strlen(event_id::VARCHAR) || ':' || event_id) AS source_id FROM events",
)
def _lineage_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [scan("events"), keep("event_id", "value"), op("Sort", keys=[{"field": "value", "direction": "desc"}, {"field": "event_id"}])]
    made = validated(ops, {"obligation_type": "LINEAGE_CAPTURE", "parameters": {"level": "record"}})
    lineage.record_fragment(made, "events", ("event_id",))
    edges = lineage.edges_v4(lineage.lower_for_records(made, bindings(spark, sf_dir)), made, "events", ("event_id",), "result-1")
    return edges.select("ordinal", F.lower(F.hex("source_id")).alias("source_id"))


# ---------------------------------------------------------------- pipeline families

_LINES = (
    "(SELECT l_orderkey * 8 + l_linenumber AS row_id, 'value-' || l_partkey AS sensitive_value, l_suppkey AS join_key, "
    "('0x' || substr(md5((l_orderkey * 8 + l_linenumber)::VARCHAR), 1, 8))::BIGINT % 10000 AS query_bucket, "
    "('0x' || substr(md5('value-' || l_partkey), 1, 8))::BIGINT % 10000 AS policy_bucket FROM lineitem)"
)
_DIMENSION = "(SELECT s_suppkey AS dimension_key, s_suppkey % 97 AS marker FROM supplier)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet").select(
        row.alias("row_id"), F.concat(F.lit("value-"), F.col("l_partkey").cast("string")).alias("sensitive_value"), F.col("l_suppkey").alias("join_key"), tables.bucket_of(row.cast("string")).alias("query_bucket")
    )


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("dimension_key"), (F.col("s_suppkey") % 97).alias("marker"))


def _longs(df: DataFrame) -> DataFrame:
    """Wide integers as long ones, so that both engines' results have one type."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields])


for _name, _way in families.PIPELINES.items():
    direct(
        f"pipeline_{_name.split('_')[0]}" + ("_first" if "first" in _name else ""),
        f"SELECT row_id, md5(sensitive_value) AS sensitive_value, marker FROM {_LINES} JOIN {_DIMENSION} ON join_key = dimension_key WHERE policy_bucket < 6000 AND query_bucket < 2500",
    )(lambda spark, sf_dir, _way=_way: _way(_lines(spark, sf_dir), _dimension(spark, sf_dir), 6000, 2500))


for _name, _way in families.TOTALS.items():
    direct(
        f"totals_{_name.removesuffix('_governed_pipeline')}",
        f"SELECT count(*) AS row_count, sum(row_id)::BIGINT AS row_id_sum, sum(marker)::BIGINT AS marker_sum FROM {_LINES} JOIN {_DIMENSION} ON join_key = dimension_key WHERE policy_bucket < 6000 AND query_bucket < 2500",
    )(lambda spark, sf_dir, _way=_way: _longs(_way(_lines(spark, sf_dir), _dimension(spark, sf_dir), 6000, 2500)))

_BY_MARKER = f"SELECT marker, count(*) AS n FROM {_LINES} JOIN {_DIMENSION} ON join_key = dimension_key WHERE policy_bucket < 6000 GROUP BY 1"
direct("agg_join_then", _BY_MARKER)(lambda spark, sf_dir: families.join_then_aggregate(_lines(spark, sf_dir), _dimension(spark, sf_dir), 6000))
direct("agg_partial_then_join", _BY_MARKER)(lambda spark, sf_dir: families.partial_aggregate_then_join(_lines(spark, sf_dir), _dimension(spark, sf_dir), 6000))

_CUTOFFS = [(3000, 5000), (6000, 2000), (9000, 500)]
_EVENTS = "(SELECT 'eq-' || event_id AS event_id, event_id % 101 AS event_value, ('0x' || substr(md5('p' || event_id), 1, 8))::BIGINT % 10000 AS policy_bucket, ('0x' || substr(md5('q' || event_id), 1, 8))::BIGINT % 10000 AS query_bucket FROM events)"
_BATCH = " UNION ALL ".join(
    f"SELECT {i} AS query_no, event_value, sha256(event_id) AS source_id FROM {_EVENTS} WHERE policy_bucket < {p} AND query_bucket < {q}" for i, (p, q) in enumerate(_CUTOFFS)
)


def _lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("event_id").cast("string")
    return tables.read_parquet(spark, f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("eq-"), name).alias("event_id"),
        (F.col("event_id") % 101).alias("event_value"),
        tables.bucket_of(F.concat(F.lit("p"), name)).alias("policy_bucket"),
        tables.bucket_of(F.concat(F.lit("q"), name)).alias("query_bucket"),
    )


for _name, _way in families.LINEAGE.items():
    direct(f"lineage_batch_{_name.split('_')[0]}", _BATCH)(lambda spark, sf_dir, _way=_way: _way(_lineage_events(spark, sf_dir), _CUTOFFS))

_MASKED = f"SELECT row_id, sha256(sensitive_value) AS sensitive_value, marker FROM {_LINES} JOIN {_DIMENSION} ON join_key = dimension_key"
direct("mask_early", _MASKED)(lambda spark, sf_dir: families.mask_early(_lines(spark, sf_dir), _dimension(spark, sf_dir)))
direct("mask_late", _MASKED)(lambda spark, sf_dir: families.mask_late(_lines(spark, sf_dir), _dimension(spark, sf_dir)))
direct("mask_aggregate", f"SELECT sha256(sensitive_value) AS sensitive_value, count(*) AS n FROM {_LINES} GROUP BY sensitive_value")(lambda spark, sf_dir: families.mask_aggregate(_lines(spark, sf_dir)))


_FLOW_LINES = f"(SELECT row_id, lpad(sensitive_value, 24, '.') AS sensitive_value, join_key FROM {_LINES})"
_FLOW_DIMENSION = f"(SELECT * FROM {_DIMENSION} WHERE dimension_key % 3 > 0)"
_FLOW_JOIN = f"FROM {_FLOW_LINES} JOIN {_FLOW_DIMENSION} ON join_key = dimension_key"
_HASH_60 = "('0x' || substr(md5(sha256(sensitive_value)), 1, 15))::BIGINT"
_FLOW_SQL = {
    "column_pruning": f"SELECT count(*) AS result_rows, sum(marker)::BIGINT AS marker_sum, sum(length(sensitive_value))::BIGINT AS payload_length_sum {_FLOW_JOIN}",
    "mask_output": f"SELECT row_id, sha256(sensitive_value) AS masked_value, marker {_FLOW_JOIN}",
    "mask_aggregate": f"SELECT count(*) AS result_rows, sum(marker)::BIGINT AS marker_sum, bit_xor({_HASH_60}) AS mask_digest {_FLOW_JOIN}",
    "mask_sorted_output": f"SELECT row_id, sha256(sensitive_value) AS masked_value, marker {_FLOW_JOIN} ORDER BY masked_value, row_id",
}


def _flow_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines with sensitive values of one width, and a dimension that two thirds of them match."""
    lines = _lines(spark, sf_dir).withColumn("sensitive_value", F.lpad("sensitive_value", 24, "."))
    return lines.select("row_id", "sensitive_value", "join_key"), _dimension(spark, sf_dir).where("dimension_key % 3 > 0")


for _group, _ways in families.flows(24).items():
    for _name in _ways:
        direct(f"flow_{_name}", _FLOW_SQL[_group])(lambda spark, sf_dir, _g=_group, _n=_name: _longs(families.flows(24)[_g][_n](*_flow_tables(spark, sf_dir))))

_COMPONENT_SQL = {
    "hash_scan": f"SELECT sum(length(sensitive_value))::BIGINT AS length_sum FROM {_FLOW_LINES}",
    "hash_sha256": f"SELECT sum(length(sha256(sensitive_value)))::BIGINT AS length_sum FROM {_FLOW_LINES}",
    "join_payload_baseline": f"SELECT row_id, sensitive_value, 0::BIGINT AS marker FROM {_FLOW_LINES} WHERE join_key IN (SELECT dimension_key FROM {_FLOW_DIMENSION})",
    "join_payload": f"SELECT row_id, sensitive_value, marker {_FLOW_JOIN}",
    "materialization_write": f"SELECT row_id, sensitive_value FROM {_FLOW_LINES}",
    "materialization_read": f"SELECT count(*) AS row_count, sum(length(sensitive_value))::BIGINT AS length_sum FROM {_FLOW_LINES}",
    "early_mask_fragment": _FLOW_SQL["mask_sorted_output"],
    "late_mask_fragment": _FLOW_SQL["mask_sorted_output"],
}
for _name, _sql in _COMPONENT_SQL.items():
    direct(f"micro_{_name}", _sql)(lambda spark, sf_dir, _n=_name: _longs(families.components()[_n](*_flow_tables(spark, sf_dir))))

_STAGED_EVENTS = """(SELECT event_id, ts AS event_time, -60.0::DOUBLE + (event_id * 37 % 1200) / 10.0::DOUBLE AS latitude, -180.0::DOUBLE + (event_id * 91 % 3600) / 10.0::DOUBLE AS longitude,
       ('0x' || substr(md5('p' || event_id), 1, 8))::BIGINT % 10000 < 7000 AS policy_allowed, user_id AS join_key FROM events)"""
_FILTERED = f"""SELECT event_id, c_mktsegment AS severity_label FROM {_STAGED_EVENTS} JOIN customer ON join_key = c_custkey
WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-25' AND policy_allowed
  AND 111.045 * sqrt(pow(latitude - 10.0, 2) + pow((longitude - 20.0) * cos(radians(10.0)), 2)) <= 6000 ORDER BY event_id"""


def _staged(run: Callable[[DataFrame, DataFrame, dict], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        k, read = F.col("event_id"), lambda t: tables.read_parquet(spark, f"{sf_dir}/{t}.parquet")
        events = read("events").select(
            k,
            F.col("ts").alias("event_time"),
            (F.lit(-60.0) + (k * 37 % 1200) / F.lit(10.0)).alias("latitude"),
            (F.lit(-180.0) + (k * 91 % 3600) / F.lit(10.0)).alias("longitude"),
            (tables.bucket_of(F.concat(F.lit("p"), k.cast("string"))) < 7000).alias("policy_allowed"),
            F.col("user_id").alias("join_key"),
        )
        dimension = read("customer").select(F.col("c_custkey").alias("dimension_key"), F.col("c_mktsegment").alias("severity_label"))
        day = lambda d: F.lit(d).cast("timestamp_ntz")
        return run(events, dimension, families.filters(day("2024-01-05"), day("2024-01-25"), (10.0, 20.0), 6000.0))

    return query


direct("filters_fused", _FILTERED)(_staged(families.filters_fused))
for _order in families.FILTER_ORDERS:
    direct(f"filters_{'_'.join(_order)}", _FILTERED)(_staged(lambda e, d, by, _order=_order: families.filters_in_order(e, d, by, _order)))
for _after in families.BOUNDARIES:
    direct(f"filters_boundary_{_after}", _FILTERED)(_staged(lambda e, d, by, _after=_after: families.filters_with_boundary(e, d, by, _after)))


# ---------------------------------------------------------------- data preparation


@direct("union_distinct", "SELECT c_nationkey::BIGINT AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [tables.read_parquet(spark, f"{sf_dir}/{t}.parquet").select(F.col(c).cast("long").alias("nationkey")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return tables.distinct_union(*parts)


@direct("row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def _row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return tables.row_numbers(orders, ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@direct("running_sum", "SELECT event_id, sum(event_id) OVER (ORDER BY user_id, event_type)::BIGINT AS running FROM events")
def _running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read_parquet(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    order = ["user_id", "event_type"]
    return events.join(tables.running_sums(events, order, "event_id", "running"), order).select("event_id", "running")


_COVERED = """WITH f AS (SELECT l_partkey AS k, count(*) AS n, ('0x' || substr(md5('7-' || l_partkey), 1, 8))::BIGINT % 10000 AS o FROM lineitem GROUP BY 1)
SELECT k AS l_partkey FROM (SELECT k, n, sum(n) OVER (ORDER BY o, k) AS s FROM f) WHERE s - n < 20000"""


@direct("coverage_selection", _COVERED)
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet").select("l_partkey")
    return tables.until_covered(lines, "l_partkey", tables.bucket_of(F.concat(F.lit("7-"), F.col("l_partkey").cast("string"))), 20_000)


@direct("count_if", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1")
def _count_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@direct("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tables.read_parquet(spark, f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'")
    orders = tables.read_parquet(spark, f"{sf_dir}/orders.parquet")
    return orders.join(chosen, orders.o_custkey == chosen.c_custkey, "left_semi").select("o_orderkey")


@direct("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@direct("bit_xor", "SELECT event_type, bit_xor(event_id) AS ids, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1")
def _bit_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read_parquet(spark, f"{sf_dir}/events.parquet")
    return df.groupBy("event_type").agg(F.bit_xor("event_id").alias("ids"), F.sum(F.octet_length("props")).cast("long").alias("bytes"))


@direct(
    "even_sample",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE (i + 1) * 500 // n > i * 500 // n",
)
def _even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.even_sample(tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 500)


@direct("seeded_sample", None)
def _seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.seeded_sample(tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 500, 42)


@direct("cents", "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


# ---------------------------------------------------------------- sources, sinks, checks


@direct("csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2))::DOUBLE AS o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders")
def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as headed text with other names, read back as strings with normalised names, cast by the catalog."""
    path = f"{tables.shared_folder(spark)}/palisade/{uuid.uuid4().hex}/orders.csv"
    orders = tables.read_parquet(spark, f"{sf_dir}/orders.parquet")
    orders.toDF(*[f"  {c.replace('_', ' ').upper()} " for c in orders.columns]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    text = tables.read_delimited(spark, path, normalize_names=True)
    return _flat(conform(text, catalog().get("orders"))).withColumn("o_orderdate", F.unix_micros("o_orderdate"))


@direct("parquet_sink", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{tables.shared_folder(spark)}/palisade/{uuid.uuid4().hex}/orders"
    tables.write_parquet(tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@direct(
    "cleaning",
    """SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS rank, TRY_CAST(o_orderstatus AS INTEGER) AS status FROM orders
WHERE TRY_CAST(left(o_orderpriority, 1) AS INTEGER) IS NOT NULL AND TRY_CAST(left(o_orderpriority, 1) AS INTEGER) BETWEEN 2 AND 4""",
)
def _cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderstatus").alias("status"))
    return tables.cleaned(raw, {"rank": "int", "status": "int"}, ["rank"], {"rank": (2, 4)})


_UNIT = "(('0x' || substr(md5('{k}-' || id), 1, 8))::BIGINT % 1000000) / 1e6"


@direct(
    "synthetic_events",
    f"""SELECT rpad('ev-' || lpad(id::VARCHAR, 12, '0'), 24, 'x') AS event_id, {1767225600000000}::BIGINT + id * 1000000 AS event_time, {_UNIT.format(k=4)} * 180 - 90 AS latitude,
       {_UNIT.format(k=5)} * 360 - 180 AS longitude, {_UNIT.format(k=6)} < 0.4 AS policy_allowed,
       CASE WHEN {_UNIT.format(k=7)} < 0.3 THEN 'key-hot' ELSE 'key-' || (('0x' || substr(md5('3-' || id), 1, 8))::BIGINT % 50) END AS join_key, {_UNIT.format(k=8)} * 9 AS magnitude
FROM range(5000) AS r(id)""",
)
def _synthetic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.synthetic_events(spark, 5000, 24, 0.4, 0.3, 50, 3).withColumn("event_time", F.unix_micros("event_time"))


@direct(
    "checksum",
    """SELECT count(*) AS row_count, bit_xor(('0x' || substr(md5(event_id || '|' || event_type || '|' || props), 1, 15))::BIGINT) AS hash_xor,
       sum(length(event_id || event_type || props))::BIGINT AS text_length FROM events""",
)
def _checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(tables.checksum(tables.read_parquet(spark, f"{sf_dir}/events.parquet"), ["event_id", "event_type", "props"]))


@direct("explain_rows", "SELECT event_type, true AS same_plan, (SELECT count(DISTINCT event_type) FROM events) AS rows_out FROM events GROUP BY event_type")
def _explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with what the plan's fingerprint and the executed plan's figures say of their query."""
    grouped = lambda: tables.read_parquet(spark, f"{sf_dir}/events.parquet").groupBy("event_type").count()
    df = grouped()
    out = min(n.metrics["numOutputRows"] for n in explain.analyze(df).walk() if "Aggregate" in n.name and "numOutputRows" in n.metrics)
    return df.select("event_type", F.lit(explain.fingerprint(df) == explain.fingerprint(grouped())).alias("same_plan"), F.lit(out).cast("long").alias("rows_out"))
