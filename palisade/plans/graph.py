"""Shape of the operator graph: references, cycles, reachability, orders."""

from __future__ import annotations

from collections import Counter

from .nodes import CandidatePlan, Diagnostic, Operator, diagnostic


def order(operators: tuple[Operator, ...]) -> tuple[list[Operator], bool]:
    """Operators with inputs first, and whether all could be placed (else there is a cycle).  Iterative: depth is
    the client's choice.  Operators that can go at the same time keep the plan's order."""
    known = {o.operator_id: o for o in operators}
    done: set[str] = set()
    out: list[Operator] = []
    on_path: set[str] = set()
    for top in operators:
        stack = [(top.operator_id, False)]
        while stack:
            name, leaving = stack.pop()
            if leaving:
                on_path.discard(name)
                done.add(name)
                out.append(known[name])
            elif name in on_path:
                return out, False
            elif name not in done and name in known:
                on_path.add(name)
                stack.append((name, True))
                stack += [(i, False) for i in reversed(known[name].inputs)]
    return out, True


def reachable(operators: tuple[Operator, ...], output: str) -> set[str]:
    known = {o.operator_id: o for o in operators}
    seen: set[str] = set()
    todo = [output]
    while todo:
        name = todo.pop()
        if name in known and name not in seen:
            seen.add(name)
            todo += known[name].inputs
    return seen


def check(plan: CandidatePlan) -> list[Diagnostic]:
    found = [
        diagnostic("INVALID_OPERATOR_ARGUMENT", "The operator has another number of inputs than it needs.", o.operator_id, expected=o.ARITY, actual=len(o.inputs))
        for o in plan.operators
        if len(o.inputs) != o.ARITY
    ]
    counts = Counter(o.operator_id for o in plan.operators)
    if repeated := sorted(k for k, n in counts.items() if n > 1):
        found.append(diagnostic("DUPLICATE_OPERATOR_ID", "Operator ids must be unique.", ids=repeated))
    if plan.output_operator not in counts:
        found.append(diagnostic("OUTPUT_OPERATOR_UNKNOWN", "The output operator is not in the plan."))
    for o in plan.operators:
        if unbound := sorted(set(o.inputs) - counts.keys()):
            found.append(diagnostic("UNBOUND_REFERENCE", "The operator names inputs that are not in the plan.", o.operator_id, inputs=unbound))
    if not order(plan.operators)[1]:
        found.append(diagnostic("CYCLIC_PLAN", "The plan has a cycle."))
    if plan.output_operator in counts and (idle := sorted(counts.keys() - reachable(plan.operators, plan.output_operator))):
        found.append(diagnostic("UNREACHABLE_OPERATOR", "Operators do not contribute to the output.", ids=idle))
    return found
