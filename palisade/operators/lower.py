"""Validated plans as DataFrames, a small function for each operator.

A node used twice is one DataFrame.  A group-size guard needs its groups' row counts, so an aggregate that one stands
after carries a hidden count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..plans import fixed, graph, nodes, schema
from ..plans.catalog import Catalog, Dataset
from ..plans.validate import ValidatedPlan
from ..sources.tables import read_parquet
from . import exact, pushdown, spatial

GROUP_ROWS = "__group_rows"


class NotExecutable(Exception):
    """The plan is valid but has no execution here."""


@dataclass
class Bindings:
    """Tables for datasets, chosen by the one who runs plans: a DataFrame, what makes one, or a path, by dataset or (dataset, version)."""

    spark: SparkSession
    tables: Mapping[str | tuple[str, str], DataFrame | Callable[[], DataFrame] | str]
    catalog: Catalog
    digits: Mapping[str, Mapping[str, int]] = field(default_factory=dict)  # by dataset and decimal field; a value with more is an error

    def table(self, dataset: str, version: str) -> DataFrame:
        found = self.tables.get((dataset, version), self.tables.get(dataset))
        if found is None:
            raise NotExecutable(f"no table is bound to {dataset}")
        if isinstance(found, str):
            return read_parquet(self.spark, found)
        return found if isinstance(found, DataFrame) else found()


def conform(df: DataFrame, dataset: Dataset, digits: Mapping[str, int] | None = None, more: tuple[F.Column, ...] = ()) -> DataFrame:
    """The catalog's fields in its order and types, and ``more``; times without zone are UTC, and decimals keep their scale."""
    have = dict(df.dtypes)

    def one(f) -> F.Column:
        c = E.column(f.name)
        if f.data_type == "decimal" and have.get(f.name, "").startswith("decimal"):
            return c
        if f.data_type == "decimal":
            return c.cast(f"decimal({(digits or {}).get(f.name, 15)},2)").alias(f.name)
        return c.cast(E.SPARK_TYPE[f.data_type]).alias(f.name)

    return df.select(*map(one, dataset.fields), *more)


@dataclass
class Context:
    plan: ValidatedPlan
    bindings: Bindings
    relations: dict[str, schema.Relation]
    operators: tuple[nodes.Operator, ...]
    guarded: set[str] = field(default_factory=set)  # aggregates with a group-size guard after them
    summed: dict[str, set[str]] = field(default_factory=dict)  # fields of scans that aggregates add up
    digits: dict[str, int] = field(default_factory=dict)  # of fields that come as hundredths too


def _scan(op: nodes.ScanSource, c: Context) -> DataFrame:
    version = c.plan.data_snapshots[op.dataset]
    dataset = c.bindings.catalog.get(op.dataset)
    stored = pushdown.restrict(c.bindings.table(op.dataset, version), pushdown.bounds(c.operators, op.operator_id), dataset)
    digits, kinds = c.bindings.digits.get(op.dataset, {}), dict(stored.dtypes)
    exactly = sorted(n for n in c.summed.get(op.operator_id, set()) & digits.keys() if kinds.get(n) == "double")
    c.digits |= {n: digits[n] for n in exactly}
    return conform(stored, dataset, digits, tuple(exact.hundredths(n, digits[n]) for n in exactly))


def _spatial_filter(op: nodes.SpatialFilter, c: Context, df: DataFrame) -> DataFrame:
    pairs = [p for p in c.relations[op.inputs[0]].spatial if p.crs == op.crs]
    if op.crs != fixed.WGS84 or len(pairs) != 1:
        raise NotExecutable("a radius needs exactly one pair of degrees")
    if abs(op.center[0]) > 90 or abs(op.center[1]) > 180:
        raise NotExecutable("the centre is (latitude, longitude)")
    lat, lon = E.column(pairs[0].latitude_field), E.column(pairs[0].longitude_field)
    reach = op.radius_km / fixed.KM_PER_DEGREE * (1 + 1e-9)
    near = lat.between(op.center[0] - reach, op.center[0] + reach)  # a bound that reaches the scan
    return df.where(near & (E.planar_km(lat, lon, op.center) <= F.lit(op.radius_km)))


def _temporal_filter(op: nodes.TemporalFilter, c: Context, df: DataFrame) -> DataFrame:
    t = E.column(op.field)
    return df.where((t >= E.instant(op.start)) & (t < E.instant(op.end)))


def _join(op: nodes.Join, c: Context, left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, E.column(op.left_field) == E.column(op.right_field), op.join_type)


def _spatial_join(op: nodes.SpatialJoin, c: Context, left: DataFrame, right: DataFrame) -> DataFrame:
    if op.relation != "distance_within":
        raise NotExecutable(f"{op.relation} has no execution")
    if {p.crs for i in op.inputs for p in c.relations[i].spatial if p.names & {*op.left_fields, *op.right_fields}} != {fixed.WGS84}:
        raise NotExecutable("distances are between degrees")
    return spatial.within(left, right, op.left_fields, op.right_fields, op.distance_km)


def _sort(op: nodes.Sort, c: Context, df: DataFrame) -> DataFrame:
    return df.orderBy(*[E.column(k.field).asc_nulls_last() if k.direction == "asc" else E.column(k.field).desc_nulls_last() for k in op.keys])


def _aggregate_column(item: nodes.AggregateItem, df: DataFrame, c: Context) -> F.Column:
    if item.function == "count":
        return F.count(F.lit(1)).alias(item.output_field)
    value = E.numeric(item.input_expression) if item.input_expression else E.column(item.input_field)
    total = exact.total(item, set(df.columns), c.digits) if c.digits and item.function in ("sum", "avg") else None
    if item.function == "avg" and (total is not None or df.select(value).schema[0].dataType.typeName() == "decimal"):
        # from the exact sum, which the same aggregation often has already; no value becomes a double on its own
        total = F.sum(value) if total is None else total
        return (total.cast("double") / F.count(value)).alias(item.output_field)
    if item.function == "avg":
        return F.avg(value.cast("double")).alias(item.output_field)
    return (total if total is not None else getattr(F, item.function)(value)).alias(item.output_field)


def _aggregate(op: nodes.Aggregate, c: Context, df: DataFrame) -> DataFrame:
    items = [_aggregate_column(a, df, c) for a in op.aggregates]
    if op.operator_id in c.guarded:
        items.append(F.count(F.lit(1)).alias(GROUP_ROWS))
    return df.groupBy(*map(E.column, op.group_by)).agg(*items)


def _mask(op: nodes.Mask, c: Context, df: DataFrame) -> DataFrame:
    before = c.relations[op.inputs[0]]
    return df.withColumns({n: E.masked(E.column(n), op.method, before.get(n).data_type) for n in op.fields})


def _generalize(op: nodes.GeneralizeLocation, c: Context, df: DataFrame) -> DataFrame:
    pairs = [p for p in c.relations[op.inputs[0]].spatial if p.names <= set(op.fields)]
    if len(pairs) != 1 or pairs[0].crs != fixed.WGS84 or set(op.fields) != pairs[0].names:
        raise NotExecutable("a grid needs exactly one pair of degrees")
    lat, lon = pairs[0].latitude_field, pairs[0].longitude_field
    return df.withColumns({lat: E.grid_centre(E.column(lat), op.precision_km, 90.0), lon: E.grid_centre(E.column(lon), op.precision_km, 180.0)})


def _min_group(op: nodes.MinGroupSize, c: Context, df: DataFrame) -> DataFrame:
    if GROUP_ROWS not in df.columns:
        raise NotExecutable("a group-size guard needs the aggregate's groups")
    return df.where(F.col(GROUP_ROWS) >= op.minimum_count)


def _project(op: nodes.Project, c: Context, df: DataFrame) -> DataFrame:
    hidden = [F.col(GROUP_ROWS)] if GROUP_ROWS in df.columns else []
    return df.select(*map(E.column, op.fields), *hidden)


def _lineage(op: nodes.LineageCapture, c: Context, df: DataFrame) -> DataFrame:
    if op.level == "record":
        raise NotExecutable("record lineage has an entry of its own")
    return df


LOWER: dict[str, Callable[..., DataFrame]] = {
    "ScanSource": _scan,
    "SpatialFilter": _spatial_filter,
    "TemporalFilter": _temporal_filter,
    "Filter": lambda op, c, df: df.where(E.predicate(op.expression)),
    "Join": _join,
    "SpatialJoin": _spatial_join,
    "Project": _project,
    "Sort": _sort,
    "Limit": lambda op, c, df: df.limit(op.row_count),
    "Aggregate": _aggregate,
    "Mask": _mask,
    "GeneralizeLocation": _generalize,
    "MinGroupSize": _min_group,
    "LineageCapture": _lineage,
}


def _guarded(operators: tuple[nodes.Operator, ...]) -> set[str]:
    """Aggregates whose groups a guard counts: the nearest one upstream over operators that keep groups whole."""
    known = {o.operator_id: o for o in operators}
    out = set()
    for o in operators:
        at = known.get(o.inputs[0]) if isinstance(o, nodes.MinGroupSize) else None
        while at is not None and not isinstance(at, nodes.Aggregate):
            at = known.get(at.inputs[0]) if len(at.inputs) == 1 else None
        if at is not None:
            out.add(at.operator_id)
    return out


def lower(plan: ValidatedPlan, bindings: Bindings, boundary: Callable[[str, DataFrame], DataFrame] | None = None, operators: tuple[nodes.Operator, ...] | None = None, output: str | None = None) -> DataFrame:
    """The DataFrame of ``plan``, or of another arrangement of its operators.

    ``boundary(operator_id, df)`` may put a storage boundary after an operator.
    """
    operators = operators or plan.operators
    output = output or plan.output_operator
    arranged = nodes.CandidatePlan("1.0", plan.candidate_plan_id, plan.request_context, plan.requested_output, operators, output)
    if faults := graph.check(arranged):
        raise NotExecutable(faults[0].message)
    relations, faults = schema.check(arranged, bindings.catalog)
    if faults:
        raise NotExecutable(f"{faults[0].code}: {faults[0].message}")
    context = Context(plan, bindings, relations, operators, _guarded(operators), {} if boundary else exact.scans(operators))
    made: dict[str, DataFrame] = {}
    for op in graph.order(operators)[0]:
        df = LOWER[op.operator_type](op, context, *[made[i] for i in op.inputs])
        made[op.operator_id] = boundary(op.operator_id, df) if boundary else df
    return made[output].select(*map(E.column, relations[output].names))
