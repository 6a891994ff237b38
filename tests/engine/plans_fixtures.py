"""Small catalogs and plans that the tests share."""

from palisade import testing_catalog
from palisade.plans.catalog import Catalog
from palisade.plans.policy import PolicySet
from palisade.testing_catalog import compare as comparison  # noqa: F401
from palisade.testing_catalog import op  # noqa: F401

CATALOG = {
    "datasets": [
        {
            "dataset_id": "quakes",
            "versions": ["v2026-06", "v2026-05"],
            "default_version": "v2026-06",
            "fields": [
                {"name": "event_id", "data_type": "string", "roles": ["identifier"]},
                {"name": "event_time", "data_type": "datetime", "roles": ["temporal"]},
                {"name": "latitude", "data_type": "float", "roles": ["spatial"], "nullable": True},
                {"name": "longitude", "data_type": "float", "roles": ["spatial"], "nullable": True},
                {"name": "magnitude", "data_type": "float", "nullable": True},
                {"name": "note", "data_type": "string", "nullable": True, "sensitive": True},
            ],
            "spatial": {"latitude_field": "latitude", "longitude_field": "longitude", "crs": "EPSG:4326"},
            "temporal_field": "event_time",
        },
        {
            "dataset_id": "scores",
            "versions": ["v1"],
            "default_version": "v1",
            "fields": [{"name": "score_key", "data_type": "float", "nullable": True}, {"name": "severity", "data_type": "string"}],
        },
        {
            "dataset_id": "sites",
            "versions": ["v1"],
            "default_version": "v1",
            "fields": [
                {"name": "site_id", "data_type": "string"},
                {"name": "site_lat", "data_type": "float", "roles": ["spatial"], "sensitive": True},
                {"name": "site_lon", "data_type": "float", "roles": ["spatial"], "sensitive": True},
                {"name": "amount", "data_type": "decimal"},
                {"name": "visits", "data_type": "integer"},
            ],
            "spatial": {"latitude_field": "site_lat", "longitude_field": "site_lon", "crs": "EPSG:4326"},
        },
    ]
}


def catalog() -> Catalog:
    return Catalog.read(CATALOG)


def rule(decision="PERMIT", obligations=(), resources=("quakes", "scores", "sites"), policy_id="r", **more) -> dict:
    return {
        "policy_id": policy_id,
        "policy_version": "7",
        "subject_roles": ["geologist"],
        "purposes": ["study"],
        "actions": ["read", "aggregate", "join"],
        "resources": list(resources),
        "decision": decision,
        "obligations": list(obligations),
        "reason": "r",
        **more,
    }


def policies(*rules: dict) -> PolicySet:
    return PolicySet.read({"policy_set_id": "p", "policy_snapshot": "ps-1", "rules": list(rules) or [rule()]})


def obligation(kind: str, **parameters) -> dict:
    return {"obligation_type": kind, "parameters": parameters}


def plan(*operators: dict, fields=(), purpose="study", action="read", output=None) -> dict:
    for i, o in enumerate(operators):
        o.setdefault("operator_id", f"op-{i}")
        if o["operator_type"] != "ScanSource":
            o.setdefault("inputs", [operators[i - 1]["operator_id"]])
    out = {
        "plan_id": "t",
        "request_context": {"subject": {"subject_id": "s", "role": "geologist"}, "action": action},
        "requested_output": {"fields": list(fields)},
        "operators": list(operators),
        "output_operator": output or operators[-1]["operator_id"],
    }
    if purpose:
        out["request_context"]["purpose"] = purpose
    return out


def scan(dataset="quakes", **more):
    return testing_catalog.scan(dataset, **more)
