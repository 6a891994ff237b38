"""The plan format: fourteen operators, their expressions, and the candidate plan around them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, ClassVar

from . import fixed
from .shapes import Record, anything, boolean, choice, exactly, fault, instant, integer, listing, mapping, maybe, number, record, tagged, text

_DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?")
_names = listing(text())


def _literal(v: Any, at: str) -> Any:
    if type(v) not in (str, int, float, bool):
        raise fault(at, "a scalar is needed")
    return v


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class FieldRef(Record):
    expression_type: str
    field: str
    SHAPE: ClassVar = {"expression_type": exactly("field"), "field": text(1)}


@dataclass(frozen=True)
class Literal(Record):
    expression_type: str
    data_type: str
    value: Any
    SHAPE: ClassVar = {"expression_type": exactly("literal"), "data_type": choice(*fixed.TYPES), "value": _literal}

    def faults(self):
        python = {"string": (str,), "integer": (int,), "float": (int, float), "decimal": (str,), "boolean": (bool,), "datetime": (str,)}
        if type(self.value) not in python[self.data_type]:
            yield f"{self.value!r} is no {self.data_type} literal"
        elif self.data_type == "decimal" and not _DECIMAL.fullmatch(self.value):
            yield "a decimal literal is a plain base-10 string"
        elif self.data_type == "datetime":
            try:
                offset = datetime.fromisoformat(self.value.replace("Z", "+00:00")).utcoffset()
            except ValueError:
                yield "a datetime literal is ISO-8601"
            else:
                if offset is None:
                    yield "a datetime literal has a UTC offset"


@dataclass(frozen=True)
class Comparison(Record):
    expression_type: str
    operator: str
    left: FieldRef
    right: Literal
    negated: bool
    SHAPE: ClassVar = {
        "expression_type": exactly("comparison"),
        "operator": choice(*fixed.COMPARISONS),
        "left": record(FieldRef),
        "right": record(Literal),
        "negated": (boolean, False),
    }


@dataclass(frozen=True)
class BooleanGroup(Record):
    expression_type: str
    operator: str
    operands: tuple[Comparison, ...]
    negated: bool
    SHAPE: ClassVar = {
        "expression_type": exactly("boolean"),
        "operator": choice("and", "or"),
        "operands": listing(record(Comparison), 2),
        "negated": (boolean, False),
    }


@dataclass(frozen=True)
class Product(Record):
    expression_type: str
    left: FieldRef
    right: FieldRef
    SHAPE: ClassVar = {"expression_type": exactly("numeric_product"), "left": record(FieldRef), "right": record(FieldRef)}


@dataclass(frozen=True)
class Affine(Record):
    expression_type: str
    constant: Literal
    operator: str
    field: FieldRef
    SHAPE: ClassVar = {"expression_type": exactly("numeric_affine"), "constant": record(Literal), "operator": choice("add", "subtract"), "field": record(FieldRef)}

    def faults(self):
        if self.constant.data_type != "decimal":
            yield "the constant must be a decimal literal"


@dataclass(frozen=True)
class Formula(Record):
    expression_type: str
    factors: tuple[FieldRef | Affine, ...]
    SHAPE: ClassVar = {
        "expression_type": exactly("numeric_product_formula"),
        "factors": listing(tagged("expression_type", {"field": FieldRef, "numeric_affine": Affine}), 2, 3),
    }


def fields_of(expression: Product | Formula) -> tuple[str, ...]:
    """Names of the fields that a numeric expression reads."""
    if isinstance(expression, Product):
        return expression.left.field, expression.right.field
    return tuple(f.field.field if isinstance(f, Affine) else f.field for f in expression.factors)


# ---------------------------------------------------------------- operators


@dataclass(frozen=True)
class Operator(Record):
    operator_id: str
    inputs: tuple[str, ...]
    operator_type: str
    BASE: ClassVar = {"operator_id": text(), "inputs": (_names, ())}
    ARITY: ClassVar[int] = 1


def _shape(name: str, **more: Any) -> dict:
    return {**Operator.BASE, "operator_type": exactly(name), **more}


@dataclass(frozen=True)
class ScanSource(Operator):
    dataset: str
    snapshot: str | None
    ARITY: ClassVar[int] = 0
    SHAPE: ClassVar = _shape("ScanSource", dataset=text(), snapshot=(maybe(text()), None))


@dataclass(frozen=True)
class SpatialFilter(Operator):
    """Rows within a radius; ``center`` is (latitude, longitude)."""

    center: tuple[float, float]
    radius_km: float
    crs: str
    SHAPE: ClassVar = _shape("SpatialFilter", center=listing(number(), 2, 2), radius_km=number(True), crs=(text(), fixed.WGS84))


@dataclass(frozen=True)
class TemporalFilter(Operator):
    field: str
    start: datetime
    end: datetime
    SHAPE: ClassVar = _shape("TemporalFilter", field=text(), start=instant, end=instant)


@dataclass(frozen=True)
class Filter(Operator):
    expression: Comparison | BooleanGroup
    SHAPE: ClassVar = _shape("Filter", expression=tagged("expression_type", {"comparison": Comparison, "boolean": BooleanGroup}))


@dataclass(frozen=True)
class Join(Operator):
    left_field: str
    right_field: str
    join_type: str
    ARITY: ClassVar[int] = 2
    SHAPE: ClassVar = _shape("Join", left_field=text(), right_field=text(), join_type=(choice("inner", "left"), "inner"))


@dataclass(frozen=True)
class SpatialJoin(Operator):
    relation: str
    left_fields: tuple[str, str]
    right_fields: tuple[str, str]
    distance_km: float | None
    ARITY: ClassVar[int] = 2
    SHAPE: ClassVar = _shape(
        "SpatialJoin",
        relation=choice("intersects", "within", "distance_within"),
        left_fields=listing(text(), 2, 2),
        right_fields=listing(text(), 2, 2),
        distance_km=(maybe(number(True)), None),
    )

    def faults(self):
        for pair in (self.left_fields, self.right_fields):
            if pair[0] == pair[1] or not all(x.strip() for x in pair):
                yield "a coordinate pair names two different fields"
        if (self.relation == "distance_within") != (self.distance_km is not None):
            yield "distance_km goes with distance_within, and only with it"


@dataclass(frozen=True)
class Project(Operator):
    fields: tuple[str, ...]
    SHAPE: ClassVar = _shape("Project", fields=_names)


@dataclass(frozen=True)
class SortKey(Record):
    field: str
    direction: str
    SHAPE: ClassVar = {"field": text(1), "direction": (choice("asc", "desc"), "asc")}


@dataclass(frozen=True)
class Sort(Operator):
    keys: tuple[SortKey, ...]
    SHAPE: ClassVar = _shape("Sort", keys=listing(record(SortKey), 1))


@dataclass(frozen=True)
class Limit(Operator):
    row_count: int
    SHAPE: ClassVar = _shape("Limit", row_count=integer(1, 10_000))


@dataclass(frozen=True)
class AggregateItem(Record):
    function: str
    input_field: str | None
    input_expression: Product | Formula | None
    output_field: str
    SHAPE: ClassVar = {
        "function": choice(*fixed.AGGREGATES),
        "input_field": (maybe(text()), None),
        "input_expression": (maybe(tagged("expression_type", {"numeric_product": Product, "numeric_product_formula": Formula})), None),
        "output_field": text(1),
    }

    def faults(self):
        inputs = (self.input_field is not None) + (self.input_expression is not None)
        if inputs != (self.function != "count"):
            yield "count has no input, and every other aggregate exactly one"
        if self.input_expression is not None and self.function not in ("sum", "avg"):
            yield "numeric expressions go with sum and avg"


@dataclass(frozen=True)
class Aggregate(Operator):
    group_by: tuple[str, ...]
    aggregates: tuple[AggregateItem, ...]
    SHAPE: ClassVar = _shape("Aggregate", group_by=_names, aggregates=listing(record(AggregateItem), 1))


@dataclass(frozen=True)
class Mask(Operator):
    fields: tuple[str, ...]
    method: str
    SHAPE: ClassVar = _shape("Mask", fields=listing(text(), 1), method=(choice("redact", "hash", "null"), "redact"))


@dataclass(frozen=True)
class GeneralizeLocation(Operator):
    fields: tuple[str, ...]
    precision_km: float
    method: str
    preserves_selection: bool
    SHAPE: ClassVar = _shape(
        "GeneralizeLocation", fields=listing(text(), 1), precision_km=number(True), method=(exactly("fixed_grid"), "fixed_grid"), preserves_selection=(exactly(True), True)
    )


@dataclass(frozen=True)
class MinGroupSize(Operator):
    minimum_count: int
    SHAPE: ClassVar = _shape("MinGroupSize", minimum_count=integer(2))


@dataclass(frozen=True)
class LineageCapture(Operator):
    level: str
    SHAPE: ClassVar = _shape("LineageCapture", level=choice(*fixed.LINEAGE_LEVELS))


OPERATORS: dict[str, type[Operator]] = {
    c.__name__: c
    for c in (ScanSource, SpatialFilter, TemporalFilter, Filter, Join, SpatialJoin, Project, Sort, Limit, Aggregate, Mask, GeneralizeLocation, MinGroupSize, LineageCapture)
}


def make(name: str, operator_id: str, inputs: tuple[str, ...] = (), **arguments: Any) -> Operator:
    """A node built from plain values, checked like a client's."""
    return OPERATORS[name].read({"operator_type": name, "operator_id": operator_id, "inputs": list(inputs), **arguments})


# ---------------------------------------------------------------- the candidate plan


@dataclass(frozen=True)
class Subject(Record):
    subject_id: str
    role: str
    attributes: dict[str, str]
    SHAPE: ClassVar = {"subject_id": text(), "role": text(), "attributes": (mapping(text()), dict)}


@dataclass(frozen=True)
class TimeWindow(Record):
    dimension: str
    start: datetime
    end: datetime
    SHAPE: ClassVar = {"dimension": choice("event_time", "valid_time", "publication_time"), "start": instant, "end": instant}

    def faults(self):
        if self.end <= self.start:
            yield "the window must end after its start"


@dataclass(frozen=True)
class RequestContext(Record):
    subject: Subject
    purpose: str | None
    action: str
    query_time_window: TimeWindow | None
    SHAPE: ClassVar = {
        "subject": record(Subject),
        "purpose": (maybe(text()), None),
        "action": choice(*fixed.ACTIONS),
        "query_time_window": (maybe(record(TimeWindow)), None),
    }


@dataclass(frozen=True)
class ExportRequest(Record):
    requested: bool = False
    destination: str | None = None
    format: str | None = None
    SHAPE: ClassVar = {"requested": (boolean, False), "destination": (maybe(text()), None), "format": (maybe(choice("json", "csv", "parquet")), None)}


@dataclass(frozen=True)
class RequestedOutput(Record):
    fields: tuple[str, ...]
    export: ExportRequest = field(default_factory=ExportRequest)
    lineage_level: str = "none"
    SHAPE: ClassVar = {"fields": _names, "export": (record(ExportRequest), ExportRequest), "lineage_level": (choice(*fixed.LINEAGE_LEVELS), "none")}


@dataclass(frozen=True)
class CandidatePlan(Record):
    schema_version: str
    plan_id: str
    request_context: RequestContext
    requested_output: RequestedOutput
    operators: tuple[Operator, ...]
    output_operator: str
    SHAPE: ClassVar = {
        "schema_version": (exactly("1.0"), "1.0"),
        "plan_id": text(),
        "request_context": record(RequestContext),
        "requested_output": record(RequestedOutput),
        "operators": listing(tagged("operator_type", OPERATORS)),
        "output_operator": text(),
    }

    def by_id(self) -> dict[str, Operator]:
        return {o.operator_id: o for o in self.operators}


@dataclass(frozen=True)
class Diagnostic(Record):
    code: str
    message: str
    operator_id: str | None = None
    policy_id: str | None = None
    details: dict[str, Any] = field(default_factory=dict)
    SHAPE: ClassVar = {
        "code": choice(*fixed.REASON_CODES),
        "message": text(),
        "operator_id": (maybe(text()), None),
        "policy_id": (maybe(text()), None),
        "details": (mapping(anything), dict),
    }


def diagnostic(code: str, message: str, operator_id: str | None = None, **details: Any) -> Diagnostic:
    return Diagnostic(code, message, operator_id, None, details)
