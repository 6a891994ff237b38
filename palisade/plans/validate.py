"""From a client's JSON to a validated plan, or to the reasons why not.

The order is a security boundary: structure, purpose, graph, types, policy, obligations, and then the rewritten plan goes
through graph, types and proof once more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any, ClassVar

from . import graph, nodes, policy, schema
from .catalog import Catalog
from .nodes import CandidatePlan, Diagnostic, Operator, diagnostic
from .shapes import Record, ShapeError, canonical


@dataclass(frozen=True)
class ValidatedPlan(Record):
    logical_plan_id: str
    candidate_plan_id: str
    request_context: nodes.RequestContext
    requested_output: nodes.RequestedOutput
    operators: tuple[Operator, ...]
    output_operator: str
    output_schema: tuple
    lineage_requirements: tuple
    lineage_instrumentation: tuple
    policy_snapshot: str
    data_snapshots: dict[str, str]
    satisfied_obligations: tuple[str, ...]
    pending_obligations: tuple[str, ...]
    rounds: int
    reason_codes: tuple[str, ...]
    canonical_digest: str
    boundary_operator: str
    SHAPE: ClassVar = {}

    def plain(self) -> dict:
        from .shapes import plain

        first = "logical_plan_id candidate_plan_id request_context requested_output operators output_operator output_schema lineage_requirements lineage_instrumentation".split()
        return (
            {"schema_version": "1.0"}
            | {k: plain(getattr(self, k)) for k in first}
            | {
                "bindings": {"policy_snapshot": self.policy_snapshot, "data_snapshots": dict(self.data_snapshots)},
                "satisfied_obligations": list(self.satisfied_obligations),
                "pending_obligations": list(self.pending_obligations),
                "validation": {"rounds": self.rounds, "reason_codes": list(self.reason_codes), "canonical_digest": self.canonical_digest},
            }
        )

    def by_id(self) -> dict[str, Operator]:
        return {o.operator_id: o for o in self.operators}


@dataclass(frozen=True)
class Response(Record):
    status: str
    candidate_plan_id: str | None = None
    policy_decision: str | None = None
    diagnostics: tuple[Diagnostic, ...] = ()
    validated_plan: ValidatedPlan | None = None
    SHAPE: ClassVar = {k: None for k in ("status", "candidate_plan_id", "policy_decision", "diagnostics", "validated_plan")}

    def plain(self) -> dict:
        return {"schema_version": "1.0", **super().plain()}

    @property
    def codes(self) -> list[str]:
        return [d.code for d in self.diagnostics]


def parse(raw: Any) -> CandidatePlan:
    return CandidatePlan.read(raw)


def digest_of(plan: CandidatePlan) -> str:
    return "sha256:" + hashlib.sha256(canonical(plan).encode()).hexdigest()


_REFUSAL = {"DENY": "POLICY_DENIED", "NOT_APPLICABLE": "POLICY_NOT_APPLICABLE", "INDETERMINATE": "POLICY_INDETERMINATE"}


def snapshots_of(operators: tuple[Operator, ...], catalog: Catalog) -> dict[str, str]:
    return {o.dataset: o.snapshot or catalog.get(o.dataset).default_version for o in operators if isinstance(o, nodes.ScanSource)}


def validate(raw: Any, policies: policy.PolicySet, catalog: Catalog, strict_deny: bool = False) -> Response:
    """ACCEPT as it is, REWRITE with obligations added, CLARIFY for want of a purpose, or REJECT."""
    try:
        plan = parse(raw)
    except ShapeError as e:
        name = raw.get("plan_id") if isinstance(raw, dict) else None
        code = "UNKNOWN_OPERATOR" if "unknown_tag" in e.kinds else "PLAN_PARSE_ERROR"
        errors = [{"place": p.lstrip("."), "message": m} for p, _, m in e.faults]
        return Response("REJECT", name if isinstance(name, str) else None, None, (diagnostic(code, "The plan is not well formed.", errors=errors),))
    decision: str | None = None

    def reject(found) -> Response:
        return Response("REJECT", plan.plan_id, decision, tuple(found))

    if plan.request_context.purpose is None:
        return Response("CLARIFY", plan.plan_id, "INDETERMINATE", (diagnostic("PURPOSE_MISSING", "The request needs a purpose."),))
    if found := graph.check(plan) or schema.check(plan, catalog)[1]:
        return reject(found)
    evaluation = policy.evaluate(plan, policies, strict_deny)
    decision = evaluation.decision
    if decision != "PERMIT":
        return reject([diagnostic(_REFUSAL[decision], evaluation.reason)])
    obligations, found = policy.normalize(evaluation.obligations)
    if found:
        return reject(found)
    try:
        rewritten, reasons = policy.enforce(plan, obligations)
    except policy.Unenforceable as e:
        return reject([e.found])
    if found := graph.check(rewritten):
        return reject(found)
    relations, found = schema.check(rewritten, catalog)
    if found:
        return reject(found)
    snapshots = snapshots_of(rewritten.operators, catalog)
    proof = policy.prove(obligations, rewritten.operators, plan.output_operator, rewritten.output_operator, snapshots)
    if proof.found:
        return reject(proof.found)
    digest = digest_of(rewritten)
    validated = ValidatedPlan(
        logical_plan_id="pl-" + digest.split(":")[1][:16],
        candidate_plan_id=plan.plan_id,
        request_context=plan.request_context,
        requested_output=plan.requested_output,
        operators=rewritten.operators,
        output_operator=rewritten.output_operator,
        output_schema=relations[rewritten.output_operator].fields,
        lineage_requirements=proof.requirements,
        lineage_instrumentation=proof.instrumentation,
        policy_snapshot=policies.policy_snapshot,
        data_snapshots=snapshots,
        satisfied_obligations=proof.satisfied,
        pending_obligations=proof.pending,
        rounds=2 if reasons else 1,
        reason_codes=reasons,
        canonical_digest=digest,
        boundary_operator=plan.output_operator,
    )
    notes = tuple(diagnostic(r, "An obligation was added to the plan.") for r in reasons)
    return Response("REWRITE" if reasons else "ACCEPT", plan.plan_id, decision, notes, validated)
