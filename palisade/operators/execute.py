"""Running approved plans: boundaries, results, evidence and the certificate."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans import certificate, physical
from ..plans.validate import ValidatedPlan
from ..sources.tables import stored
from . import lineage
from .lower import Bindings, NotExecutable, lower


def compile_plan(plan: ValidatedPlan, bindings: Bindings) -> DataFrame:
    """The plan as it is, for Catalyst to arrange."""
    return lower(plan, bindings)


def compile_approved(plan: ValidatedPlan, approved: physical.PhysicalPlan, bindings: Bindings) -> DataFrame:
    """The arrangement of an approved plan, if it still is what planning the same strategy gives.

    A boundary is written to the shared folder and read back, so that what follows starts from stored rows.
    """
    again = physical.plan_physical(plan, approved.strategy, approved.planner_decision_digest, approved.planner_selected_candidate_id)
    if again != approved:
        raise NotExecutable("the physical plan is not what its strategy gives")
    if approved.unimplemented_backend_features:
        raise NotExecutable("parts of the plan have no execution: " + ", ".join(approved.unimplemented_backend_features))
    operators, output, boundaries = physical.arrangement(plan, approved.strategy)
    return lower(plan, bindings, lambda name, df: stored(df, name) if name in boundaries else df, operators, output)


@dataclass(frozen=True)
class Execution:
    result: DataFrame
    certificate: certificate.Certificate
    verification: certificate.Verification


def run(plan: ValidatedPlan, bindings: Bindings, strategy: physical.Strategy | None = None) -> Execution:
    """Execute, capture source lineage, certify and verify; the result stays distributed."""
    approved = physical.plan_physical(plan, strategy)
    result = compile_approved(plan, approved, bindings)
    digest = lineage.unordered_digest(result)
    execution_id = uuid.uuid4().hex
    evidence, lineage_digest = lineage.capture_sources(plan, execution_id, digest)
    made = certificate.certify(plan, approved, execution_id, digest, evidence, lineage_digest)
    return Execution(result, made, certificate.verify(plan, approved, made, digest))
