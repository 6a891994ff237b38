import copy
import itertools
import json
import random

import pytest

from palisade.cli import main
from palisade.plans import fixed, nodes, policy
from palisade.plans.shapes import ShapeError
from palisade.plans.validate import validate

from .plans_fixtures import CATALOG, catalog, comparison, obligation, op, plan, policies, rule, scan

GRID = obligation("GENERALIZE_LOCATION", fields=["site_lat", "site_lon"], precision_km=5)
SOURCE = obligation("LINEAGE_CAPTURE", level="source")


def accept():
    return plan(scan(), op("TemporalFilter", field="event_time", start="2026-06-01T00:00:00Z", end="2026-07-01T00:00:00Z"), fields=["event_id", "magnitude"])


def rewrite():
    return plan(scan("sites", operator_id="scan"), op("SpatialFilter", center=[39.9, 116.3], radius_km=50), fields=["site_id"])


def at(raw, *path, **changes):
    out = copy.deepcopy(raw)
    x = out
    for p in path:
        x = x[p]
    x.update(changes)
    return out


GOVERNED = (rule(resources=["quakes"]), rule(resources=["sites"], obligations=[GRID, SOURCE], policy_id="s"), rule("DENY", resources=["scores"], policy_id="d"))
NEITHER = {"requested": False, "destination": None, "format": "csv"}
MATRIX = [
    *[("ACCEPT", [], p) for p in (
        accept(), at(accept(), plan_id="other"), at(accept(), "operators", 0, snapshot="v2026-06"), at(accept(), "requested_output", fields=["event_id"]),
        at(accept(), "requested_output", lineage_level="source"), at(accept(), "request_context", action="aggregate"),
        at(accept(), "request_context", "subject", attributes={"org": "x"}), at(accept(), "requested_output", export=NEITHER))],
    *[("REWRITE", ["SPATIAL_PRECISION_EXCEEDED", "LINEAGE_REQUIRED"], p) for p in (
        rewrite(), at(rewrite(), plan_id="other"), at(rewrite(), "operators", 0, snapshot="v1"), at(rewrite(), "requested_output", lineage_level="source"),
        at(rewrite(), "requested_output", lineage_level="none"), at(rewrite(), "request_context", action="aggregate"),
        at(rewrite(), "request_context", "subject", attributes={"clearance": "x"}), at(rewrite(), "operators", 1, radius_km=5))],
    *[("CLARIFY", ["PURPOSE_MISSING"], at(p, "request_context", purpose=None)) for p in (
        accept(), at(accept(), plan_id="other"), at(accept(), "request_context", action="aggregate"), at(accept(), "request_context", "subject", role="public"),
        at(accept(), "requested_output", lineage_level="record"), at(accept(), "operators", 0, snapshot="v2026-06"),
        at(accept(), "request_context", "subject", attributes={"org": "x"}), at(accept(), "requested_output", export=NEITHER | {"requested": True}))],
    ("REJECT", ["POLICY_DENIED"], plan(scan("scores"))),
    ("REJECT", ["UNKNOWN_DATASET"], plan(scan("nothing"))),
    ("REJECT", ["UNKNOWN_FIELD"], at(accept(), "requested_output", fields=["nothing"])),
    ("REJECT", ["VERSION_UNRESOLVED"], at(accept(), "operators", 0, snapshot="v0")),
    ("REJECT", ["UNBOUND_REFERENCE", "UNREACHABLE_OPERATOR"], at(accept(), "operators", 1, inputs=["nothing"])),
    ("REJECT", ["CYCLIC_PLAN"], plan(scan(operator_id="s"), op("Join", operator_id="a", inputs=["s", "b"], left_field="event_id", right_field="event_id"), op("Limit", operator_id="b", inputs=["a"], row_count=1))),
    ("REJECT", ["UNKNOWN_OPERATOR"], plan(scan(), op("Explode"))),
    ("REJECT", ["POLICY_NOT_APPLICABLE"], at(accept(), "request_context", purpose="advertising")),
]


@pytest.mark.parametrize("status,codes,raw", MATRIX, ids=range(1, 33))
def test_decision_matrix(status, codes, raw):
    first = validate(raw, policies(*GOVERNED), catalog())
    assert (first.status, first.codes) == (status, codes)
    assert validate(raw, policies(*GOVERNED), catalog()) == first
    assert (first.validated_plan is not None) == (status in ("ACCEPT", "REWRITE"))
    json.dumps(first.plain())


def test_rewriting_keeps_the_radius_and_appends():
    made = validate(rewrite(), policies(*GOVERNED), catalog()).validated_plan
    assert [o.operator_type for o in made.operators] == ["ScanSource", "SpatialFilter", "GeneralizeLocation", "LineageCapture"]
    assert made.by_id()["op-1"].radius_km == 50 and made.operators[2].operator_id == "gov-001-generalizelocation"
    assert made.pending_obligations == ("LINEAGE_CAPTURE",) and made.satisfied_obligations == ("GENERALIZE_LOCATION",)
    assert made.logical_plan_id == "pl-" + made.canonical_digest[7:23] and made.boundary_operator == "op-1"


def test_taken_ids_are_avoided():
    raw = rewrite()
    raw["operators"][1]["operator_id"] = raw["output_operator"] = "gov-001-generalizelocation"
    made = validate(raw, policies(*GOVERNED), catalog()).validated_plan
    assert made.operators[2].operator_id == "gov-001-generalizelocation-1"


BAD = [
    (lambda p: p.update(extra=1)),
    (lambda p: p["operators"][0].update(extra=1)),
    (lambda p: p.pop("output_operator")),
    (lambda p: p["operators"].append(op("Limit", operator_id="l", inputs=["op-1"], row_count=True))),
    (lambda p: p["operators"].append(op("Limit", operator_id="l", inputs=["op-1"], row_count=10001))),
    (lambda p: p["operators"].append(op("Filter", operator_id="l", inputs=["op-1"], expression="magnitude > 3"))),
    (lambda p: p["operators"].append(op("Filter", operator_id="l", inputs=["op-1"], expression=comparison("magnitude", "gt", "integer", True)))),
    (lambda p: p["operators"].append(op("Filter", operator_id="l", inputs=["op-1"], expression=comparison("magnitude", "gt", "decimal", "1e3")))),
    (lambda p: p["operators"].append(op("Filter", operator_id="l", inputs=["op-1"], expression=comparison("event_time", "gt", "datetime", "2026-01-01T00:00:00")))),
    (lambda p: p["operators"].append(op("Mask", operator_id="l", inputs=["op-1"], fields=[]))),
    (lambda p: p["operators"].append(op("SpatialJoin", operator_id="l", inputs=["op-1", "op-1"], relation="within", left_fields=["a", "b"], right_fields=["c", "d"], distance_km=3))),
]


@pytest.mark.parametrize("change", BAD, ids=range(len(BAD)))
def test_malformed_plans(change):
    raw = accept()
    change(raw)
    assert validate(raw, policies(), catalog()).codes == ["PLAN_PARSE_ERROR"]
    with pytest.raises(ShapeError):
        nodes.CandidatePlan.read(raw)


def agg(function="sum", **more):
    return op("Aggregate", group_by=["event_id"], aggregates=[{"function": function, "output_field": "x", **more}])


TYPES = [
    ("DUPLICATE_OUTPUT_FIELD", [scan(), op("Project", fields=["event_id", "event_id"])]),
    ("FIELD_NOT_AVAILABLE", [scan(), op("Project", fields=["nothing"])]),
    ("INVALID_OPERATOR_ARGUMENT", [scan(), op("Sort", keys=[{"field": "event_id"}, {"field": "event_id", "direction": "desc"}])]),
    ("SPATIAL_FIELD_REQUIRED", [scan(), op("Project", fields=["latitude"]), op("SpatialFilter", center=[0, 0], radius_km=1)]),
    ("SPATIAL_CRS_MISMATCH", [scan(), op("SpatialFilter", center=[0, 0], radius_km=1, crs="EPSG:3857")]),
    ("TEMPORAL_FIELD_TYPE_INVALID", [scan(), op("TemporalFilter", field="magnitude", start="2026-01-01T00:00:00Z", end="2026-02-01T00:00:00Z")]),
    ("INVALID_TIME_RANGE", [scan(), op("TemporalFilter", field="event_time", start="2026-02-01T00:00:00Z", end="2026-02-01T00:00:00Z")]),
    ("EXPRESSION_TYPE_MISMATCH", [scan(), op("Filter", expression=comparison("event_id", "gt", "string", "a"))]),
    ("EXPRESSION_TYPE_MISMATCH", [scan(), op("Filter", expression=comparison("magnitude", "eq", "string", "a"))]),
    ("AGGREGATE_TYPE_NOT_SUPPORTED", [scan(), agg("sum", input_field="note")]),
    ("AGGREGATE_TYPE_NOT_SUPPORTED", [scan(), agg("max", input_field="note")]),
    ("MASK_INPUT_TYPE_UNSUPPORTED", [scan(), op("Mask", fields=["magnitude"], method="hash")]),
    ("MASKED_FIELD_USED_SEMANTICALLY", [scan(), op("Mask", fields=["note"]), op("Filter", expression=comparison("note", "eq", "string", "a"))]),
    ("MASKED_FIELD_USED_SEMANTICALLY", [scan(), op("Mask", fields=["event_id"]), op("Sort", keys=[{"field": "event_id"}])]),
    ("MASKED_FIELD_USED_SEMANTICALLY", [scan(), op("Mask", fields=["event_id"]), agg("count")]),
    ("GENERALIZATION_TARGET_NOT_SPATIAL", [scan(), op("GeneralizeLocation", fields=["latitude"], precision_km=1)]),
    ("SPATIAL_FIELD_REQUIRED", [scan(), op("Mask", fields=["latitude"]), op("SpatialFilter", center=[0, 0], radius_km=1)]),
    ("JOIN_KEY_TYPE_MISMATCH", [scan(operator_id="a"), scan("scores", operator_id="b"), op("Join", operator_id="j", inputs=["a", "b"], left_field="event_id", right_field="score_key")]),
    ("AMBIGUOUS_OUTPUT_FIELD", [scan(operator_id="a"), scan(operator_id="b"), op("Join", operator_id="j", inputs=["a", "b"], left_field="event_id", right_field="event_id")]),
    ("SPATIAL_DESCRIPTOR_NOT_FOUND", [scan(operator_id="a"), scan("sites", operator_id="b"), op("SpatialJoin", operator_id="j", inputs=["a", "b"], relation="distance_within", left_fields=["longitude", "latitude"], right_fields=["site_lat", "site_lon"], distance_km=1)]),
    ("DUPLICATE_OPERATOR_ID", [scan(operator_id="a"), op("Limit", operator_id="a", inputs=["a"], row_count=1)]),
]


@pytest.mark.parametrize("code,operators", TYPES, ids=[f"{i}-{c}" for i, (c, _) in enumerate(TYPES)])
def test_type_rules(code, operators):
    response = validate(plan(*copy.deepcopy(operators)), policies(), catalog())
    assert response.status == "REJECT" and code in response.codes


def test_only_first_causes_are_told():
    raw = plan(scan(), op("Project", fields=["nothing"]), op("Sort", keys=[{"field": "nothing"}]))
    assert validate(raw, policies(), catalog()).codes == ["FIELD_NOT_AVAILABLE"]


def test_derived_schema():
    raw = plan(
        scan("sites"),
        op("Aggregate", group_by=["site_id"], aggregates=[
            {"function": "count", "output_field": "n"}, {"function": "sum", "input_field": "amount", "output_field": "a"}, {"function": "avg", "input_field": "visits", "output_field": "v"},
            {"function": "max", "input_field": "site_lat", "output_field": "top"}]),
        op("Mask", fields=["n"], method="null"),
    )
    made = {f.name: f for f in validate(raw, policies(), catalog()).validated_plan.output_schema}
    assert (made["a"].data_type, made["v"].data_type, made["top"].data_type) == ("decimal", "float", "float")
    assert made["top"].sensitive and not made["a"].sensitive
    assert (made["n"].data_type, made["n"].value_state, made["n"].nullable) == ("integer", "nullified", True)


def test_left_join_makes_the_right_side_nullable():
    raw = plan(scan(operator_id="a"), scan("scores", operator_id="b"), op("Join", operator_id="j", inputs=["a", "b"], left_field="magnitude", right_field="score_key", join_type="left"))
    made = {f.name: f for f in validate(raw, policies(), catalog()).validated_plan.output_schema}
    assert made["severity"].nullable


# ---------------------------------------------------------------- obligations

ASKED = [
    (obligation("VERSION_PIN"), "a"),
    (obligation("MASK", fields=["note", "event_id"], method="hash"), "a"),
    (obligation("MASK", fields=["note"], method="hash"), "b"),
    (obligation("MASK", fields=["severity"]), "c"),
    (obligation("GENERALIZE_LOCATION", fields=["longitude", "latitude"], precision_km=5), "a"),
    (obligation("GENERALIZE_LOCATION", fields=["latitude", "longitude"], precision_km=20), "b"),
    (obligation("MIN_GROUP_SIZE", minimum_count=5), "a"),
    (obligation("MIN_GROUP_SIZE", minimum_count=7), "c"),
    (obligation("LINEAGE_CAPTURE", level="record"), "a"),
    (obligation("LINEAGE_CAPTURE", level="source"), "b"),
    (obligation("EXPORT_CONTROL", to="x"), "a"),
    (obligation("EXPORT_CONTROL", to="x"), "b"),
]


def asked(items):
    return tuple((policy.Obligation.read(o), s) for o, s in items)


def test_normalization_is_order_free_and_idempotent():
    base, found = policy.normalize(asked(ASKED))
    assert not found
    r = random.Random(1)
    for _ in range(200):
        items = ASKED + r.sample(ASKED, 4)
        r.shuffle(items)
        assert policy.normalize(asked(items))[0] == base
    again, _ = policy.normalize(tuple((m.obligation, "x") for m in base))
    assert [m.obligation for m in again] == [m.obligation for m in base]
    kinds = [m.obligation.obligation_type for m in base]
    assert kinds == ["VERSION_PIN", "GENERALIZE_LOCATION", "MASK", "MASK", "MIN_GROUP_SIZE", "LINEAGE_CAPTURE", "EXPORT_CONTROL"]
    assert base[1].obligation.parameters["precision_km"] == 20 and base[1].sources == ("a", "b")
    assert base[2].obligation.parameters == {"fields": ["event_id", "note"], "method": "hash"}
    assert base[5].obligation.parameters == {"level": "record"} and base[4].obligation.parameters == {"minimum_count": 7}


@pytest.mark.parametrize(
    "bad", [obligation("VERSION_PIN", v=1), obligation("MASK"), obligation("MASK", fields=["a"], method="x"), obligation("MIN_GROUP_SIZE", minimum_count=1), obligation("MIN_GROUP_SIZE", minimum_count=True),
            obligation("GENERALIZE_LOCATION", fields=["a"], precision_km=0), obligation("LINEAGE_CAPTURE", level="all"), obligation("LINEAGE_CAPTURE", level="source", x=1)])
def test_bad_parameters(bad):
    response = validate(accept(), policies(rule(obligations=[bad])), catalog())
    assert response.codes == ["OBLIGATION_PARAMETER_INVALID"]


def test_conflicts_and_unsupported():
    both = rule(obligations=[obligation("MASK", fields=["note"]), obligation("MASK", fields=["note"], method="null")])
    assert validate(accept(), policies(both), catalog()).codes == ["MASK_METHOD_CONFLICT"]
    assert validate(accept(), policies(rule(obligations=[obligation("EXPORT_CONTROL")])), catalog()).codes == ["OBLIGATION_CONFLICT"]
    assert validate(accept(), policies(rule(obligations=[obligation("MIN_GROUP_SIZE", minimum_count=3)])), catalog()).codes == ["OBLIGATION_CONFLICT"]


def test_deny_overrides_in_any_order():
    rules = [rule(), rule("DENY", policy_id="d"), rule("INDETERMINATE", policy_id="i")]
    for order in itertools.permutations(rules):
        assert validate(accept(), policies(*order), catalog()).codes == ["POLICY_DENIED"]
    assert validate(accept(), policies(rules[0], rules[2]), catalog()).codes == ["POLICY_INDETERMINATE"]


def test_strict_deny_covers_joins():
    raw = plan(scan(operator_id="a"), scan("scores", operator_id="b"), op("Join", operator_id="j", inputs=["a", "b"], left_field="magnitude", right_field="score_key"))
    rules = policies(rule(), rule("DENY", resources=["scores"], policy_id="d"))
    assert validate(raw, rules, catalog()).status == "ACCEPT"
    assert validate(raw, rules, catalog(), strict_deny=True).codes == ["POLICY_DENIED"]


def test_an_operator_before_the_boundary_proves_nothing():
    asked_ = policy.normalize(asked([(obligation("MASK", fields=["note"]), "a")]))[0]
    ops = (nodes.make("ScanSource", "s", dataset="quakes"), nodes.make("Mask", "m", ("s",), fields=["note"]))
    assert policy.prove(asked_, ops, "m", "m", {}).found[0].code == "OBLIGATION_NOT_ENFORCED"
    assert policy.prove(asked_, ops, "s", "m", {}).satisfied == ("MASK",)


def test_codes_are_the_contract():
    assert len(fixed.REASON_CODES) == len(set(fixed.REASON_CODES)) == 64


def test_catalog_faults():
    from palisade.plans.catalog import Catalog

    for change in ({"default_version": "x"}, {"temporal_field": "magnitude"}, {"spatial": {"latitude_field": "note", "longitude_field": "longitude", "crs": "c"}}):
        with pytest.raises(ShapeError):
            Catalog.read(at(CATALOG, "datasets", 0, **change))


def test_cli(tmp_path, capsys):
    for name, value in (("p", accept()), ("c", CATALOG), ("o", policies().plain())):
        (tmp_path / name).write_text(json.dumps(value))
    assert main(["validate", str(tmp_path / "p"), "--policy", str(tmp_path / "o"), "--catalog", str(tmp_path / "c")]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "ACCEPT"
