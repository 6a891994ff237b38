import hashlib
import math
import random
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palisade.operators import execute, families, lineage, spatial
from palisade.operators.lower import Bindings, NotExecutable, lower
from palisade.plans import certificate, physical
from palisade.plans.validate import validate
from palisade.sources import tables

from .plans_fixtures import catalog, comparison, obligation, op, plan, policies, rule, scan

QUAKES = [
    ("q1", datetime(2026, 6, 1), 39.9, 116.4, 4.8, "near"),
    ("q2", datetime(2026, 6, 2), 40.1, 116.2, 5.1, None),
    ("q3", datetime(2026, 6, 3), None, 10.0, 5.1, "Ünïcode"),
    ("q4", datetime(2026, 7, 1), -89.9, 179.9, None, "pole"),
]
SCORES = [(4.8, "moderate"), (5.1, "strong"), (5.1, "felt"), (None, "none")]
SITES = [("s1", 39.95, 116.35, Decimal("10.10"), 3), ("s2", 39.95, 116.35, Decimal("0.20"), 4), ("s3", -89.95, -179.9, Decimal("5.00"), 9)]


@pytest.fixture(scope="module")
def bound(spark):
    quakes = spark.createDataFrame(QUAKES, "event_id string, event_time timestamp_ntz, latitude double, longitude double, magnitude double, note string")
    return Bindings(
        spark,
        {
            "quakes": quakes.withColumn("not_in_the_catalog", F.lit(1)),
            "scores": spark.createDataFrame(SCORES, "score_key double, severity string"),
            "sites": spark.createDataFrame(SITES, "site_id string, site_lat double, site_lon double, amount decimal(15,2), visits int"),
        },
        catalog(),
    )


def made(*operators, obligations=(), **more):
    response = validate(plan(*operators, **more), policies(rule(obligations=obligations)), catalog())
    assert response.validated_plan, response.codes
    return response.validated_plan


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scan_has_the_catalog_fields_in_utc(bound):
    df = lower(made(scan()), bound)
    assert df.columns == ["event_id", "event_time", "latitude", "longitude", "magnitude", "note"]
    assert dict(df.dtypes)["event_time"] == "timestamp"


def test_filters_are_three_valued(bound):
    for negated, want in ((False, ["q2", "q3"]), (True, ["q1"])):
        df = lower(made(scan(), op("Filter", expression=comparison("magnitude", "gt", "integer", 5, negated)), op("Project", fields=["event_id"])), bound)
        assert rows(df) == [(x,) for x in want]


def test_time_range_is_half_open(bound):
    df = lower(made(scan(), op("TemporalFilter", field="event_time", start="2026-06-01T00:00:00Z", end="2026-06-03T02:00:00+02:00"), op("Project", fields=["event_id"])), bound)
    assert rows(df) == [("q1",), ("q2",)]


def test_radius(bound):
    df = lower(made(scan(), op("SpatialFilter", center=[39.9, 116.4], radius_km=25), op("Project", fields=["event_id"])), bound)
    x = (116.2 - 116.4) * math.cos(math.radians(39.9))
    assert 111.045 * math.hypot(0.2, x) > 25
    assert rows(df) == [("q1",)]
    with pytest.raises(NotExecutable):
        lower(made(scan(), op("SpatialFilter", center=[116.4, 39.9], radius_km=25)), bound)


@pytest.mark.parametrize("kind,count", [("inner", 5), ("left", 6)])
def test_joins_and_null_keys(bound, kind, count):
    p = made(scan(operator_id="a"), scan("scores", operator_id="b"), op("Join", operator_id="j", inputs=["a", "b"], left_field="magnitude", right_field="score_key", join_type=kind))
    out = lower(p, bound).select("event_id", "severity").collect()
    assert len(out) == count
    assert [r.severity for r in out if r.event_id == "q4"] == ([None] if kind == "left" else [])


def test_sorting_puts_nulls_last(bound):
    for direction in ("asc", "desc"):
        df = lower(made(scan(), op("Sort", keys=[{"field": "magnitude", "direction": direction}, {"field": "event_id"}]), op("Limit", row_count=4)), bound)
        assert [r.event_id for r in df.collect()][-1] == "q4"


def test_aggregates(bound):
    items = [
        {"function": "count", "output_field": "n"},
        {"function": "sum", "input_field": "amount", "output_field": "total"},
        {"function": "avg", "input_field": "visits", "output_field": "mean"},
        {"function": "sum", "output_field": "net", "input_expression": {"expression_type": "numeric_product_formula", "factors": [
            {"expression_type": "field", "field": "amount"},
            {"expression_type": "numeric_affine", "operator": "subtract", "constant": {"expression_type": "literal", "data_type": "decimal", "value": "1"}, "field": {"expression_type": "field", "field": "amount"}}]}},
    ]
    (r,) = lower(made(scan("sites"), op("Aggregate", group_by=[], aggregates=items)), bound).collect()
    assert (r.n, r.total, r.mean) == (3, Decimal("15.30"), 16 / 3)
    assert r.net == sum(a * (1 - a) for _, _, _, a, _ in SITES)
    empty = made(scan("sites"), op("Filter", expression=comparison("visits", "gt", "integer", 99)), op("Aggregate", group_by=[], aggregates=items[:2]))
    assert rows(lower(empty, bound)) == [(0, None)]


def test_sums_in_longs_are_those_of_decimals(spark, bound):
    """Doubles at and near ties, nulls, negative values, sums over products and affine factors, with joins and filters below."""
    r = random.Random(4)
    special = [1.005, 2.675, -1.005, 0.015, -0.125, 0.125, 99999.994, None, -0.0, 1e-9]
    data = [(f"s{i}", 1.0, 1.0, r.choice(special) if i % 3 else round(r.uniform(-9999, 9999), 2), i) for i in range(600)]
    tables_ = {**bound.tables, "sites": spark.createDataFrame(data, "site_id string, site_lat double, site_lon double, amount double, visits long")}
    field_ = {"expression_type": "field", "field": "amount"}
    affine = lambda sign, v: {"expression_type": "numeric_affine", "operator": sign, "constant": {"expression_type": "literal", "data_type": "decimal", "value": v}, "field": field_}
    items = [{"function": f, "output_field": f"{f}{i}", **x} for f in ("sum", "avg") for i, x in enumerate([
        {"input_field": "amount"}, {"input_expression": {"expression_type": "numeric_product", "left": field_, "right": field_}},
        {"input_expression": {"expression_type": "numeric_product_formula", "factors": [field_, affine("subtract", "1"), affine("add", "0.25")]}},
        {"input_expression": {"expression_type": "numeric_product_formula", "factors": [field_, affine("subtract", "1.125")]}}])]
    items.append({"function": "count", "output_field": "n"})
    joined = [scan("sites", operator_id="a"), op("Filter", operator_id="f", inputs=["a"], expression=comparison("visits", "ge", "integer", 50)), scan("scores", operator_id="b"),
              op("Join", operator_id="j", inputs=["f", "b"], left_field="site_lat", right_field="score_key", join_type="left"), op("Aggregate", operator_id="g", inputs=["j"], group_by=["severity"], aggregates=items)]
    for operators in ([scan("sites"), op("Aggregate", group_by=["site_lat"], aggregates=items)], joined):
        p = made(*operators)
        plain = lower(p, Bindings(spark, tables_, catalog()))
        fast = lower(p, Bindings(spark, tables_, catalog(), {"sites": {"amount": 7}}))
        assert fast.columns == plain.columns
        (a,), (b,) = plain.collect(), fast.collect()
        for name in fast.columns:
            assert a[name] == (pytest.approx(b[name], rel=1e-12) if name.startswith("avg") else b[name]), name
        text = fast._jdf.queryExecution().optimizedPlan().toString()
        assert "__hundredths_amount" in text and "sum(shiftright(" in text
    none = lower(made(scan("sites"), op("Filter", expression=comparison("visits", "lt", "integer", 0)), op("Aggregate", group_by=[], aggregates=items)), Bindings(spark, tables_, catalog(), {"sites": {"amount": 7}}))
    assert set(none.first()) == {None, 0}
    kept = lower(made(scan("sites"), op("Project", fields=["amount"]), op("Aggregate", group_by=[], aggregates=items[:1])), Bindings(spark, tables_, catalog(), {"sites": {"amount": 7}}))
    assert "__hundredths" not in kept._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|out of range|cannot be represented"):
        lower(made(scan("sites"), op("Aggregate", group_by=[], aggregates=items[:1])), Bindings(spark, tables_, catalog(), {"sites": {"amount": 4}})).collect()


def test_masks(bound):
    for method, want in (("redact", "[REDACTED]"), ("null", None), ("hash", hashlib.sha256("Ünïcode".encode()).hexdigest())):
        df = lower(made(scan(), op("Project", fields=["event_id", "note"]), op("Mask", fields=["note"], method=method)), bound)
        got = dict(map(tuple, df.collect()))
        assert got["q3"] == want and got["q2"] == ("[REDACTED]" if method == "redact" else None)


def test_grid_after_a_filter(bound):
    df = lower(made(scan(), op("SpatialFilter", center=[39.9, 116.4], radius_km=50), op("GeneralizeLocation", fields=["latitude", "longitude"], precision_km=10)), bound)
    side = 10 / 111.045
    for r in df.collect():
        raw = next(q for q in QUAKES if q[0] == r.event_id)
        for x, c, o in ((raw[2], r.latitude, 90), (raw[3], r.longitude, 180)):
            assert c == pytest.approx(math.floor((x + o) / side) * side - o + side / 2, abs=1e-9)
            assert abs(c - x) <= side / 2 + 1e-9


def test_group_size_guard(bound):
    items = [{"function": "sum", "input_field": "visits", "output_field": "v"}]
    p = made(scan("sites"), op("Aggregate", group_by=["site_lat", "site_lon"], aggregates=items), op("Project", fields=["v"]), obligations=[obligation("MIN_GROUP_SIZE", minimum_count=2)])
    assert rows(lower(p, bound)) == [(7,)]


def test_chained_distance_joins(bound):
    p = made(
        scan(operator_id="a"), scan("sites", operator_id="b"),
        op("SpatialJoin", operator_id="j", inputs=["a", "b"], relation="distance_within", left_fields=["latitude", "longitude"], right_fields=["site_lat", "site_lon"], distance_km=30),
        op("Project", operator_id="p", fields=["event_id", "site_id"]),
    )
    assert rows(lower(p, bound)) == [("q1", "s1"), ("q1", "s2"), ("q2", "s1"), ("q2", "s2"), ("q4", "s3")]
    fails = made(
        scan(operator_id="a"), scan("sites", operator_id="b"),
        op("SpatialJoin", operator_id="j", inputs=["a", "b"], relation="within", left_fields=["latitude", "longitude"], right_fields=["site_lat", "site_lon"]),
    )
    with pytest.raises(NotExecutable):
        lower(fails, bound)


@pytest.mark.parametrize("km", [1, 55, 800, 5000, 12000, 21000])
def test_cells_find_what_all_pairs_find(spark, km):
    r = random.Random(km)
    special = [(90.0, 0.0), (-90.0, 45.0), (89.99, -180.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (60.0, -179.9), (None, 1.0), (1.0, None)]
    point = lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    left = [(i, *p) for i, p in enumerate(special + [point() for _ in range(150)])]
    near = [(p[1] + r.gauss(0, km / 150), p[2] + r.gauss(0, km / 150)) for p in left if None not in p]
    right = [(i, *p) for i, p in enumerate(special + [point() for _ in range(80)] + [(max(-90.0, min(90.0, a)), b) for a, b in near])]
    l, q = spark.createDataFrame(left, "i int, la double, lo double"), spark.createDataFrame(right, "j int, ra double, ro double")
    args = (l, q, ("la", "lo"), ("ra", "ro"), km)
    got = spatial.within(*args).select("i", "j")
    assert rows(got) == rows(spatial.within_by_all_pairs(*args).select("i", "j"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- variants


def mask_plan():
    return made(
        scan(operator_id="op-scan"), op("Filter", operator_id="op-f1", expression=comparison("magnitude", "ge", "float", 4)),
        op("TemporalFilter", operator_id="op-f2", field="event_time", start="2026-06-01T00:00:00Z", end="2026-08-01T00:00:00Z"),
        op("Project", operator_id="op-p", fields=["event_id", "magnitude", "note"]), scan("scores", operator_id="op-s"),
        op("Join", operator_id="op-j", inputs=["op-p", "op-s"], left_field="magnitude", right_field="score_key"), op("Sort", operator_id="op-o", keys=[{"field": "event_id"}, {"field": "severity"}]),
        obligations=[obligation("MASK", fields=["note"], method="hash"), obligation("LINEAGE_CAPTURE", level="source")],
    )


def test_all_variants_agree(bound):
    p = mask_plan()
    mask = next(o.operator_id for o in p.operators if o.operator_type == "Mask")
    found = physical.candidates(p, ("op-p", "op-j"), (("op-f2", "op-f1"), ("op-f1", "op-f2")), ((mask, "op-p"),), ((mask, "op-p"),))
    assert [c.strategy.strategy_id for c in found] == [
        "fused", "materialize-after-op-p", "materialize-after-op-j", "ordered-materialized-f2-then-f1", "ordered-materialized-f1-then-f2",
        "place-001-mask-after-p", "materialize-place-001-mask-after-p"]
    assert len({c.physical_plan_id for c in found}) == len(found)
    want = [tuple(r) for r in lower(p, bound).collect()]
    for c in found:
        assert [tuple(r) for r in execute.compile_approved(p, c, bound).collect()] == want, c.strategy
        assert physical.check_dag(c) == []
    with pytest.raises(NotExecutable):
        execute.compile_approved(p, found[1].with_(strategy=found[2].strategy), bound)


def test_illegal_variants_are_refused():
    p = mask_plan()
    mask = next(o.operator_id for o in p.operators if o.operator_type == "Mask")
    P = physical
    for s in (
        P.Strategy("x", "materialized", ("nothing",)), P.Strategy("x", "materialized", (p.output_operator,)), P.Strategy("x", "ordered_materialized", (), ("op-f1", "op-p")),
        P.Strategy("x", "ordered_materialized", (), ("op-f1",)), P.Strategy("x", "fused", ("op-p",)), P.Strategy("x", "governance_placed", (), (), (P.Placement(mask, "op-scan"),)),
        P.Strategy("x", "governance_placed", (), (), (P.Placement("op-j", "op-p"),)), P.Strategy("x", "governance_placed_materialized", ("op-p",), (), (P.Placement(mask, "op-p"),)),
    ):
        with pytest.raises(P.IllegalStrategy):
            P.plan_physical(p, s)
    used = made(
        scan(operator_id="s"), op("Project", operator_id="p", fields=["event_id", "note"]), op("Sort", operator_id="o", keys=[{"field": "note"}]), obligations=[obligation("MASK", fields=["note"])]
    )
    with pytest.raises(P.IllegalStrategy):
        P.plan_physical(used, P.Strategy("x", "governance_placed", (), (), (P.Placement("gov-001-mask", "p"),)))


# ---------------------------------------------------------------- evidence


def test_run_certifies_and_tampering_is_seen(bound):
    p = mask_plan()
    done = execute.run(p, bound)
    assert done.verification.status == "PARTIAL" and done.verification.unverified == ("physical_plan_execution",)
    assert set(done.verification.verified_obligations) == {"MASK", "LINEAGE_CAPTURE"}
    run = physical.plan_physical(p)
    c = done.certificate
    from dataclasses import replace

    E = certificate.Event
    started = next(e for e in c.events if e.event_type == "OperatorStarted" and e.operator_id == "phys-op-j")
    moved = [e for e in c.events if e is not started]
    moved = [replace(e, sequence=i) for i, e in enumerate([*moved[:1], started, *moved[1:]])]
    cases = {
        "CERTIFICATE_BINDING_MISMATCH": replace(c, task_digest="x"),
        "PHYSICAL_PLAN_BINDING_MISMATCH": replace(c, physical_plan_id="x"),
        "CERTIFICATE_SNAPSHOT_MISMATCH": replace(c, data_snapshots={}),
        "CERTIFICATE_DIGEST_MISSING": replace(c, lineage_digest=None),
        "CERTIFICATE_RESULT_DIGEST_MISMATCH": replace(c, result_digest="sha256:0"),
        "CERTIFICATE_EVENT_MISSING": replace(c, events=tuple(e for e in c.events if e.event_type != "ResultMaterialized")),
        "CERTIFICATE_EVENT_ORDER_INVALID": replace(c, events=c.events[::-1]),
        "CERTIFICATE_OPERATOR_EVENT_MISSING": replace(c, events=tuple(e for e in c.events if e.operator_id != "phys-op-j")),
        "CERTIFICATE_OPERATOR_DEPENDENCY_VIOLATION": replace(c, events=tuple(moved)),
        "CERTIFICATE_PHYSICAL_OPERATOR_UNKNOWN": replace(c, events=(*c.events[:1], *(replace(e, operator_id="phys-x") if e.operator_id == "phys-op-j" else e for e in c.events[1:]))),
        "CERTIFICATE_PLANNER_DECISION_MISMATCH": replace(c, planner_decision_digest="d", planner_selected_candidate_id="c"),
        "LINEAGE_EVIDENCE_MISSING": replace(c, lineage_evidence=None),
        "LINEAGE_TARGET_NOT_COVERED": replace(c, lineage_evidence=replace(c.lineage_evidence, covered_operators=())),
        "LINEAGE_LEVEL_INSUFFICIENT": replace(c, lineage_evidence=replace(c.lineage_evidence, lineage_level="none")),
    }
    for code, bad in cases.items():
        out = certificate.verify(p, run, bad, c.result_digest)
        assert out.status == "REJECT" and code in out.codes, code
    assert isinstance(c.events[0], E)


def test_planner_binding():
    p = mask_plan()
    run = physical.plan_physical(p, None, "sha256:1", "fused")
    c = certificate.certify(p, run, "e", "sha256:r")
    assert certificate.verify(p, run, c).unverified[0] == "planner_decision"
    assert "PHYSICAL_PLAN_PLANNER_DECISION_MISMATCH" in certificate.verify(p, run, c, None, ("sha256:2", "fused")).codes


RECORDS = [obligation("LINEAGE_CAPTURE", level="record")]


def test_record_lineage_and_tampering(spark, bound):
    p = made(scan(), op("Filter", expression=comparison("magnitude", "ge", "float", 4)), op("Project", fields=["event_id", "magnitude"]), op("Sort", keys=[{"field": "event_id"}]), obligations=RECORDS)
    assert lineage.record_fragment(p, "quakes", ("event_id",)) == "op-3"
    with pytest.raises(NotExecutable):
        lower(p, bound)
    df = lineage.lower_for_records(p, bound)
    lineage.check_keys(df, ("event_id",))
    for encode in (lineage.edges_v1, lineage.edges_v2, lineage.edges_v3, lineage.edges_v4):
        edges = encode(df, p, "quakes", ("event_id",), "r")
        assert edges.count() == 3 and lineage.verify_records(edges, encode(df, p, "quakes", ("event_id",), "r"))
        assert not lineage.verify_records(edges.limit(2), edges)
        assert not lineage.verify_records(edges.unionByName(edges.limit(1)), edges)
        other = encode(df.withColumn("event_id", F.upper("event_id")), p, "quakes", ("event_id",), "r")
        assert lineage.differences(other, edges).count() == 6
    got = {r.source_record_id for r in lineage.edges_v1(df, p, "quakes", ("event_id",), "r").collect()}
    text = '{"dataset":"quakes","snapshot":"v2026-06","source_key":{"columns":["event_id"],"values":["q1"]}}'
    assert "sha256:" + hashlib.sha256(text.encode()).hexdigest() in got
    assert [r.ordinal for r in lineage.edges_v4(df, p, "quakes", ("event_id",), "r").orderBy("ordinal").collect()] == [0, 1, 2]


def test_places_are_unique_over_many_partitions(spark):
    """A million rows sorted into many partitions of uneven size, with and without adaptive coalescing."""
    from palisade import testing_catalog as T

    plan_ = T.validated([T.scan("events"), T.op("Project", fields=["event_id", "value"]), T.op("Sort", keys=[{"field": "value"}, {"field": "event_id"}])], obligation("LINEAGE_CAPTURE", level="record"))
    n = 1_000_000
    result = spark.range(n).select(F.col("id").alias("event_id"), F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double").alias("value"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            spark.conf.set("spark.sql.shuffle.partitions", "13")
            edges = lineage.edges_v4(result.orderBy("value", "event_id"), plan_, "events", ("event_id",), "r")
            got = edges.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal"), F.count_distinct("source_id")).first()
            assert tuple(got) == (n, 0, n - 1, n)
            first = [bytes(r.source_id).hex() for r in edges.where("ordinal < 3").orderBy("ordinal").collect()]
            ids = [r.event_id for r in result.where("value = 0").orderBy("event_id").limit(3).collect()]
            assert first == [hashlib.sha256(f"source|events|v1|event_id|{len(str(i))}:{i}".encode()).hexdigest() for i in ids]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_global_numbers_and_sums_against_loops(spark):
    r = random.Random(3)
    data = [(i, r.choice("abcdef") if r.random() < 0.9 else None, r.randrange(100) if r.random() < 0.9 else None) for i in range(700)]
    df = spark.createDataFrame(data, "i int, k string, v int").repartition(5)
    got = {x.i: x.n for x in tables.row_numbers(df, ["k", "i"], "n").collect()}
    assert got == {i: n for n, (i, *_) in enumerate(sorted(data, key=lambda x: (x[1] is not None, x[1] or "", x[0])), 1)}
    sums = {x.k: x.s for x in tables.running_sums(df, ["k"], "v", "s").collect()}
    for k in {k for _, k, _ in data}:
        assert sums[k] == sum(v or 0 for _, q, v in data if (q is not None, q or "") <= (k is not None, k or ""))
    none = df.where("false")
    assert tables.row_numbers(none, ["k"], "n").count() == 0 and tables.running_sums(none, ["k"], "v", "s").count() == 0
    covered = {x.k for x in tables.until_covered(df.where("k is not null"), "k", F.lit(0), 200).collect()}
    total, want = 0, set()
    for k in sorted({k for _, k, _ in data if k}):
        if total < 200:
            want.add(k)
        total += sum(q == k for _, q, _ in data)
    assert covered == want


def test_record_lineage_refusals(bound):
    agg = op("Aggregate", group_by=["event_id"], aggregates=[{"function": "count", "output_field": "n"}])
    for operators, key in (([scan(), agg], "event_id"), ([scan(), op("Mask", fields=["note"])], "note"), ([scan(), op("Project", fields=["note"])], "event_id"), ([scan("scores")], "severity")):
        with pytest.raises(lineage.LineageRefused):
            lineage.record_fragment(made(*operators, obligations=RECORDS), "quakes", (key,))
    df = bound.table("quakes", "")
    for key in ("note", "magnitude"):
        with pytest.raises(lineage.LineageRefused):
            lineage.check_keys(df, (key,))


def test_digests(spark):
    a = spark.createDataFrame([(1, Decimal("1.10"), "x"), (2, None, None), (2, None, None)], "a int, b decimal(10,2), c string")
    assert lineage.unordered_digest(a) == lineage.unordered_digest(a.orderBy(F.desc("a")).repartition(3))
    assert lineage.unordered_digest(a) != lineage.unordered_digest(a.distinct())
    assert lineage.unordered_digest(a) != lineage.unordered_digest(a.withColumnRenamed("a", "z"))
    r = [(1, Decimal("1.10"), datetime(2026, 1, 1, tzinfo=timezone.utc))]
    assert lineage.ordered_digest(["a"], r) == lineage.ordered_digest(["a"], r) != lineage.ordered_digest(["a"], r * 2)


# ---------------------------------------------------------------- families and preparation


def test_family_members_agree(spark):
    events = tables.synthetic_events(spark, 2000).select(
        F.monotonically_increasing_id().alias("row_id"), F.col("event_id").alias("sensitive_value"), "join_key", tables.bucket_of(F.col("event_id")).alias("query_bucket")
    )
    events = tables.stored(events, "events")
    dimension = events.select(F.col("join_key").alias("dimension_key")).distinct().withColumn("marker", F.length("dimension_key").cast("long"))
    outs = {n: lineage.unordered_digest(f(events, dimension, 6000, 3000)) for n, f in families.PIPELINES.items()}
    assert len(set(outs.values())) == 1
    assert rows(families.join_then_aggregate(events, dimension, 5000)) == rows(families.partial_aggregate_then_join(events, dimension, 5000))
    assert families.totals(families.fused(events, dimension, 10000, 10000)).first().row_count == 2000
    assert len({tuple(f(events, dimension, 6000, 3000).first()) for f in families.TOTALS.values()}) == 1
    part = dimension.where("marker % 2 = 0")
    for group, ways in families.flows(18).items():
        assert len({lineage.unordered_digest(f(events, part)) for f in ways.values()}) == 1, group
    parts = {n: f(events, part) for n, f in families.components().items()}
    assert parts["hash_scan"].first()[0] == 2000 * 18 and parts["hash_sha256"].first()[0] == 2000 * 64
    assert parts["join_payload_baseline"].count() == parts["join_payload"].count()
    assert tuple(parts["materialization_read"].first()) == (2000, 2000 * 18)
    assert rows(parts["early_mask_fragment"]) == rows(parts["late_mask_fragment"])


def test_filter_orders_and_boundaries_agree(spark):
    events = tables.stored(tables.synthetic_events(spark, 3000), "events")
    dimension = events.select(F.col("join_key").alias("dimension_key")).distinct().withColumn("severity_label", F.upper("dimension_key"))
    by = families.filters(F.lit("2026-01-01 00:05:00").cast("timestamp"), F.lit("2026-01-01 00:40:00").cast("timestamp"), (10.0, 20.0), 8000.0)
    want = families.filters_fused(events, dimension, by).collect()
    assert 50 < len(want) < 1500 and len(families.FILTER_ORDERS) == 6
    for order in families.FILTER_ORDERS:
        assert families.filters_in_order(events, dimension, by, order).collect() == want
    for after in families.BOUNDARIES:
        assert families.filters_with_boundary(events, dimension, by, after).collect() == want


def test_even_and_seeded_samples(spark):
    df = spark.range(1000).repartition(7)
    got = sorted(r.id for r in tables.even_sample(df, ["id"], 10).collect())
    assert got == [99 + 100 * i for i in range(10)]
    assert tables.even_sample(df.limit(0), ["id"], 10).count() == 0 and tables.even_sample(df.where("id < 3"), ["id"], 10).count() == 3
    assert rows(tables.seeded_sample(df, "id", 20, 1)) == rows(tables.seeded_sample(df.orderBy("id"), "id", 20, 1)) != rows(tables.seeded_sample(df, "id", 20, 2))


def test_sources_and_sinks(spark, tmp_path):
    import zipfile

    (tmp_path / "a.tsv").write_text("Airport ID\tCity (Name)\n1\tRome\nx\tOslo\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.tsv", "in/a.tsv")
    member = tables.extract_member(tmp_path / "a.zip", "in/a.tsv", tmp_path / "out")
    df = tables.read_delimited(spark, str(member), sep="\t", normalize_names=True)
    assert df.columns == ["airport_id", "city_name"]
    clean = tables.cleaned(df, {"airport_id": "int"}, ["airport_id"], {"airport_id": (0, 5)})
    assert rows(clean) == [(1, "Rome")]
    path = str(tmp_path / "table")
    assert tables.write_parquet(clean, path) == 1
    with pytest.raises(FileExistsError):
        tables.write_parquet(clean, path)
    assert [p.name for p in tmp_path.iterdir() if "part" in p.name] == []
    assert rows(tables.checksum(clean, ["airport_id"])) == rows(tables.checksum(spark.read.parquet(path), ["airport_id"]))


def test_streams(spark, bound, tmp_path):
    from palisade.streaming import plans

    source = tmp_path / "in"
    bound.tables["quakes"].drop("not_in_the_catalog").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    tables_ = {**bound.tables, "quakes": stream}
    p = made(scan(), op("Filter", expression=comparison("magnitude", "ge", "float", 5)), op("Project", fields=["event_id", "note"]), op("Mask", fields=["note"]))
    plans.drain_to(plans.lower_stream(p, Bindings(spark, tables_, catalog())), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(lower(p, bound))
    with pytest.raises(NotExecutable):
        plans.lower_stream(made(scan(), op("Limit", row_count=1)), bound)


def test_filters_reach_the_scan(spark, tmp_path):
    from palisade import testing_catalog as T

    rows_ = [(i, i / 1000, datetime(2024, 1, 1 + i % 28)) for i in range(2000)]
    spark.createDataFrame(rows_, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz").selectExpr("*", "1L o_custkey", "'F' o_orderstatus", "'p' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    operators = [
        scan("orders"), op("TemporalFilter", field="o_orderdate", start="2024-01-05T00:00:00Z", end="2024-01-09T00:00:00Z"),
        op("Filter", expression={"expression_type": "boolean", "operator": "and", "operands": [comparison("o_totalprice", "ge", "decimal", "0.05"), comparison("o_totalprice", "lt", "decimal", "1.2")]}),
        op("Project", fields=["o_orderkey"]),
    ]
    bound = Bindings(spark, {"orders": str(tmp_path / "orders.parquet")}, T.catalog())
    df = lower(T.validated(operators), bound)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed and "GreaterThanOrEqual(o_totalprice" in pushed
    assert "o_orderpriority" not in next(line for line in text.splitlines() if "ReadSchema" in line)
    cents = lambda x: (Decimal(repr(x)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"))
    want = [i for i, p, t in rows_ if datetime(2024, 1, 5) <= t < datetime(2024, 1, 9) and Decimal("0.05") <= cents(p) < Decimal("1.2")]
    assert sorted(r.o_orderkey for r in df.collect()) == want


def test_bounds_follow_the_catalogs_type(spark):
    """An integer field that is stored as double is cut off towards zero; no row that passes the filter may be lost below it."""
    sites = spark.createDataFrame([("a", 0.0, 0.0, 1.005, 5.9), ("b", 0.0, 0.0, 0.995, -5.9), ("c", 0.0, 0.0, 1.0, 5.0), ("d", 0.0, 0.0, 1.0, 0.9), ("e", 0.0, 0.0, 1.0, -0.9)], "site_id string, site_lat double, site_lon double, amount double, visits double")
    bound_ = Bindings(spark, {"sites": sites}, catalog())
    ids = lambda e: [x for (x,) in rows(lower(made(scan("sites"), op("Filter", expression=e), op("Project", fields=["site_id"])), bound_))]
    assert ids(comparison("visits", "eq", "integer", 5)) == ["a", "c"]
    assert ids(comparison("visits", "le", "integer", 5)) == ["a", "b", "c", "d", "e"]
    assert ids(comparison("visits", "eq", "integer", 0)) == ["d", "e"]
    assert ids(comparison("visits", "ge", "integer", -5)) == ["a", "b", "c", "d", "e"]
    assert ids(comparison("visits", "lt", "integer", 0)) == ["b"]
    assert ids(comparison("site_lat", "ge", "float", 0.0)) == ["a", "b", "c", "d", "e"]
    assert set(ids(comparison("amount", "ge", "decimal", "1.00"))) == {"a", "b", "c", "d", "e"}


def test_explain(spark, bound):
    from palisade.operators import explain

    p = made(scan(), op("Filter", expression=comparison("magnitude", "ge", "float", 5)), op("Project", fields=["event_id"]))
    df = lower(p, bound)
    assert explain.fingerprint(df) == explain.fingerprint(lower(p, bound)) != explain.fingerprint(df.limit(1))
    found = list(explain.analyze(df.groupBy("event_id").count()).walk())
    rows_out = [n.metrics["numOutputRows"] for n in found if "Aggregate" in n.name and "numOutputRows" in n.metrics]
    assert rows_out and min(rows_out) == 2
