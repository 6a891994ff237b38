"""Policies: which rules apply, what they oblige to, and how obligations combine, become operators and are proven."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, ClassVar

from . import fixed, graph, nodes
from .nodes import CandidatePlan, Diagnostic, Operator, diagnostic
from .shapes import Record, ShapeError, anything, canonical, choice, exactly, integer, listing, mapping, number, record, text

LEVEL = {name: i for i, name in enumerate(fixed.LINEAGE_LEVELS)}
_names = listing(text())


@dataclass(frozen=True)
class Obligation(Record):
    obligation_type: str
    parameters: dict[str, Any] = field(default_factory=dict)
    SHAPE: ClassVar = {"obligation_type": choice(*fixed.OBLIGATIONS), "parameters": (mapping(anything), dict)}


@dataclass(frozen=True)
class Rule(Record):
    policy_id: str
    policy_version: str
    subject_roles: tuple[str, ...]
    purposes: tuple[str, ...]
    actions: tuple[str, ...]
    resources: tuple[str, ...]
    decision: str
    obligations: tuple[Obligation, ...]
    reason: str
    SHAPE: ClassVar = {
        "policy_id": text(),
        "policy_version": text(),
        "subject_roles": _names,
        "purposes": _names,
        "actions": _names,
        "resources": _names,
        "decision": choice(*fixed.DECISIONS),
        "obligations": (listing(record(Obligation)), ()),
        "reason": text(),
    }


@dataclass(frozen=True)
class PolicySet(Record):
    schema_version: str
    policy_set_id: str
    policy_snapshot: str
    rules: tuple[Rule, ...]
    SHAPE: ClassVar = {"schema_version": (exactly("1.0"), "1.0"), "policy_set_id": text(), "policy_snapshot": text(), "rules": listing(record(Rule))}

    @classmethod
    def load(cls, path: str | Path) -> PolicySet:
        return cls.read(json.loads(Path(path).read_text(encoding="utf-8")))


# ---------------------------------------------------------------- evaluation


@dataclass(frozen=True)
class Evaluation:
    decision: str
    reason: str
    matched: tuple[Rule, ...] = ()
    obligations: tuple[tuple[Obligation, str], ...] = ()  # with the policy that asks for each


def evaluate(plan: CandidatePlan, policies: PolicySet, strict: bool = False) -> Evaluation:
    """Deny overrides, then indeterminate; a rule matches if it covers all scanned datasets.

    With ``strict``, a deny rule matches already if it covers one of them.
    """
    context = plan.request_context
    if context.purpose is None:
        return Evaluation("INDETERMINATE", "the purpose is missing")
    scanned = {o.dataset for o in plan.operators if isinstance(o, nodes.ScanSource)}

    def covers(rule: Rule) -> bool:
        return bool(scanned & set(rule.resources)) if strict and rule.decision == "DENY" else scanned <= set(rule.resources)

    matched = tuple(
        r for r in policies.rules if context.subject.role in r.subject_roles and context.purpose in r.purposes and context.action in r.actions and covers(r)
    )
    decisions = {r.decision for r in matched}
    if "DENY" in decisions:
        return Evaluation("DENY", "a rule denies it", matched)
    if "INDETERMINATE" in decisions:
        return Evaluation("INDETERMINATE", "a rule is indeterminate", matched)
    if "PERMIT" not in decisions:
        return Evaluation("NOT_APPLICABLE", "no rule permits it", matched)
    asked = tuple((o, f"{r.policy_id}@{r.policy_version}") for r in matched if r.decision == "PERMIT" for o in r.obligations)
    return Evaluation("PERMIT", "permitted", matched, asked)


# ---------------------------------------------------------------- obligations as a semilattice


def _sorted_names(v: Any, at: str) -> tuple[str, ...]:
    return tuple(sorted(set(listing(text(1), 1)(v, at))))


#: For each obligation its parameters, with defaults; none for those that are not supported.
PARAMETERS: dict[str, dict[str, Any]] = {
    "VERSION_PIN": {},
    "MASK": {"fields": _sorted_names, "method": (choice("redact", "hash", "null"), "redact")},
    "GENERALIZE_LOCATION": {"fields": _sorted_names, "precision_km": number(True), "method": (exactly("fixed_grid"), "fixed_grid")},
    "MIN_GROUP_SIZE": {"minimum_count": integer(2)},
    "LINEAGE_CAPTURE": {"level": choice(*fixed.LINEAGE_LEVELS)},
}
#: Place of each kind in the chain that is appended to a plan.
PLACE = {"VERSION_PIN": 0, "GENERALIZE_LOCATION": 10, "MASK": 20, "MIN_GROUP_SIZE": 30, "LINEAGE_CAPTURE": 40}
_UNSUPPORTED = 90
_MERGE_RULE = {
    "VERSION_PIN": "version_pin.deduplicate",
    "GENERALIZE_LOCATION": "generalize.max_precision",
    "MASK": "mask.union_fields_by_method",
    "MIN_GROUP_SIZE": "min_group_size.maximum",
    "LINEAGE_CAPTURE": "lineage.maximum_level",
}


@dataclass(frozen=True)
class Merged:
    obligation: Obligation
    sources: tuple[str, ...]
    rule: str


def _parameters(o: Obligation) -> dict[str, Any]:
    shape = PARAMETERS.get(o.obligation_type)
    if shape is None:
        return dict(sorted(o.parameters.items()))
    holder = type("Parameters", (), {"SHAPE": shape, "__init__": lambda self, **kw: self.__dict__.update(kw)})
    return {k: list(v) if isinstance(v, tuple) else v for k, v in vars(record(holder)(o.parameters, "parameters")).items()}


def normalize(asked: tuple[tuple[Obligation, str], ...]) -> tuple[tuple[Merged, ...], list[Diagnostic]]:
    """Strongest common form of obligations, whatever their order; a conflict leaves none.

    Kinds that can be strengthened are joined (largest cell, largest group, highest level); masks of one method unite
    their fields, and a field with two methods is a conflict; the rest are kept once each.
    """
    valid: list[tuple[str, dict, str]] = []
    found: list[Diagnostic] = []
    for o, source in asked:
        try:
            valid.append((o.obligation_type, _parameters(o), source))
        except ShapeError as e:
            found.append(diagnostic("OBLIGATION_PARAMETER_INVALID", str(e), obligation_type=o.obligation_type, parameters=o.parameters))
    methods: dict[str, dict[str, set[str]]] = {}
    for kind, p, source in valid:
        if kind == "MASK":
            for name in p["fields"]:
                methods.setdefault(name, {}).setdefault(p["method"], set()).add(source)
    found += [
        diagnostic("MASK_METHOD_CONFLICT", "Rules mask one field in different ways.", field=name, methods=sorted(by), source_policy_ids=sorted(set().union(*by.values())))
        for name, by in sorted(methods.items())
        if len(by) > 1
    ]
    if found:
        return (), found
    groups: dict[tuple, list[tuple[dict, str]]] = {}
    for kind, p, source in valid:
        key: Any = ""
        if kind == "MASK":
            key = p["method"]
        elif kind == "GENERALIZE_LOCATION":
            key = (tuple(p["fields"]), p["method"])
        elif kind not in PARAMETERS:
            key = canonical(p)
        groups.setdefault((kind, key), []).append((p, source))

    def join(kind: str, parts: list[dict]) -> dict:
        if kind == "MASK":
            return {"fields": sorted({n for p in parts for n in p["fields"]}), "method": parts[0]["method"]}
        if kind == "GENERALIZE_LOCATION":
            return parts[0] | {"precision_km": max(p["precision_km"] for p in parts)}
        if kind == "MIN_GROUP_SIZE":
            return {"minimum_count": max(p["minimum_count"] for p in parts)}
        if kind == "LINEAGE_CAPTURE":
            return {"level": max((p["level"] for p in parts), key=LEVEL.get)}
        return parts[0]

    merged = [
        Merged(Obligation(kind, join(kind, [p for p, _ in items])), tuple(sorted({s for _, s in items})), _MERGE_RULE.get(kind, "exact.deduplicate"))
        for (kind, _), items in groups.items()
    ]

    def place(m: Merged) -> tuple:
        o = m.obligation
        detail = f"{o.parameters['method']}:{','.join(o.parameters['fields'])}" if o.obligation_type == "MASK" else canonical(o.parameters)
        return PLACE.get(o.obligation_type, _UNSUPPORTED), o.obligation_type, detail

    return tuple(sorted(merged, key=place)), []


# ---------------------------------------------------------------- enforcement

ENFORCER = {"MASK": "Mask", "GENERALIZE_LOCATION": "GeneralizeLocation", "MIN_GROUP_SIZE": "MinGroupSize", "LINEAGE_CAPTURE": "LineageCapture"}
REASON = {"MASK": "MASK_REQUIRED", "GENERALIZE_LOCATION": "SPATIAL_PRECISION_EXCEEDED", "MIN_GROUP_SIZE": "MIN_GROUP_SIZE_REQUIRED", "LINEAGE_CAPTURE": "LINEAGE_REQUIRED"}


class Unenforceable(Exception):
    def __init__(self, found: Diagnostic):
        self.found = found


def enforce(plan: CandidatePlan, obligations: tuple[Merged, ...]) -> tuple[CandidatePlan, tuple[str, ...]]:
    """``plan`` with an operator after its output for each obligation, and the reasons for them."""
    operators, output = list(plan.operators), plan.output_operator
    taken = {o.operator_id for o in operators}
    reasons: list[str] = []
    for i, m in enumerate(obligations, 1):
        o = m.obligation
        kind = o.obligation_type
        if kind == "VERSION_PIN":
            if o.parameters:
                raise Unenforceable(diagnostic("OBLIGATION_CONFLICT", "A pin takes no parameters.", parameters=o.parameters))
            continue  # the snapshot bindings fulfil it
        if kind not in ENFORCER:
            raise Unenforceable(diagnostic("OBLIGATION_CONFLICT", "No operator enforces this obligation.", obligation_type=kind))
        known = {x.operator_id: x for x in operators}
        if kind == "MIN_GROUP_SIZE" and not any(isinstance(known[n], nodes.Aggregate) for n in graph.reachable(tuple(operators), plan.output_operator)):
            raise Unenforceable(diagnostic("OBLIGATION_CONFLICT", "A least group size needs an aggregate on the way to the output.", obligation_type=kind))
        name = base = f"gov-{i:03d}-{ENFORCER[kind].lower()}"
        n = 0
        while name in taken:  # ids in a plan are the client's choice
            n += 1
            name = f"{base}-{n}"
        try:
            added = nodes.make(ENFORCER[kind], name, (output,), **o.parameters)
        except ShapeError as e:
            raise Unenforceable(diagnostic("OBLIGATION_CONFLICT", "The obligation's parameters do not make an operator.", obligation_type=kind, error=str(e))) from e
        operators.append(added)
        taken.add(name)
        output = name
        reasons.append(REASON[kind])
    return plan.with_(operators=tuple(operators), output_operator=output), tuple(reasons)


@dataclass(frozen=True)
class LineageRequirement(Record):
    level: str
    target_operator: str
    SHAPE: ClassVar = {"level": choice(*fixed.LINEAGE_LEVELS), "target_operator": text()}


@dataclass(frozen=True)
class LineageInstrumentation(Record):
    level: str
    target_operator: str
    capture_operator: str
    capture_mode: str = "logical_suffix"
    SHAPE: ClassVar = {"level": choice(*fixed.LINEAGE_LEVELS), "target_operator": text(), "capture_operator": text(), "capture_mode": (exactly("logical_suffix"), "logical_suffix")}


@dataclass(frozen=True)
class Proof:
    satisfied: tuple[str, ...]
    pending: tuple[str, ...]
    requirements: tuple[LineageRequirement, ...]
    instrumentation: tuple[LineageInstrumentation, ...]
    found: tuple[Diagnostic, ...]


def suffix(operators: tuple[Operator, ...], boundary: str, output: str) -> list[Operator] | None:
    """Unary operators from the output back to the boundary, or None if they are no chain."""
    known = {o.operator_id: o for o in operators}
    chain: list[Operator] = []
    at = output
    while at != boundary:
        op = known.get(at)
        if op is None or len(op.inputs) != 1 or len(chain) > len(operators):
            return None
        chain.append(op)
        at = op.inputs[0]
    return chain if boundary in known else None


_MEETS: dict[str, Callable[[Operator, dict], bool]] = {
    "MASK": lambda op, p: isinstance(op, nodes.Mask) and set(p["fields"]) <= set(op.fields) and op.method == p["method"],
    "GENERALIZE_LOCATION": lambda op, p: isinstance(op, nodes.GeneralizeLocation)
    and set(p["fields"]) <= set(op.fields)
    and op.precision_km >= p["precision_km"]
    and op.method == p["method"]
    and op.preserves_selection,
    "MIN_GROUP_SIZE": lambda op, p: isinstance(op, nodes.MinGroupSize) and op.minimum_count >= p["minimum_count"],
    "LINEAGE_CAPTURE": lambda op, p: isinstance(op, nodes.LineageCapture) and LEVEL[op.level] >= LEVEL[p["level"]],
}


def prove(obligations: tuple[Merged, ...], operators: tuple[Operator, ...], boundary: str, output: str, snapshots: dict[str, str]) -> Proof:
    """Whether the chain after ``boundary`` and the bindings meet each obligation; nothing before it counts.

    Lineage stays pending: that it will be captured is proven by an execution only.
    """
    chain = suffix(operators, boundary, output)
    if chain is None:
        return Proof((), (), (), (), (diagnostic("OBLIGATION_NOT_ENFORCED", "What follows the candidate's output is no chain of unary operators."),))
    satisfied, pending, requirements, instrumentation, found = [], [], [], [], []
    scanned = {o.dataset for o in operators if isinstance(o, nodes.ScanSource)}
    for m in obligations:
        kind = m.obligation.obligation_type
        try:
            p = _parameters(m.obligation)
        except ShapeError as e:
            found.append(diagnostic("OBLIGATION_NOT_ENFORCED", str(e), obligation_type=kind))
            continue
        if kind == "VERSION_PIN":
            met = not p and bool(scanned) and all(snapshots.get(d) for d in scanned)
            by = None
        else:
            by = next((o for o in chain if kind in _MEETS and _MEETS[kind](o, p)), None)
            met = by is not None
        if kind == "LINEAGE_CAPTURE" and met:
            requirements.append(LineageRequirement(p["level"], boundary))
            instrumentation.append(LineageInstrumentation(by.level, boundary, by.operator_id))
            pending.append(kind)
        elif met:
            satisfied.append(kind)
        else:
            code = "LINEAGE_INSTRUMENTATION_MISSING" if kind == "LINEAGE_CAPTURE" else "OBLIGATION_NOT_ENFORCED"
            found.append(diagnostic(code, "The plan does not meet an obligation.", obligation_type=kind, parameters=p))
    return Proof(tuple(satisfied), tuple(pending), tuple(requirements), tuple(instrumentation), tuple(found))
