"""Bounds on physical columns that follow from a plan's filters on the catalog's types.

A filter on ``cast(column)`` does not reach a Parquet scan.  Where the cast is monotone, a necessary condition on the stored
column does: times without zone are compared as they are, a double that is read as a decimal of two places lies within half
a unit of it, and one that is read as an integer within one.  The exact filter stays above.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..plans import nodes
from ..plans.catalog import Dataset
from ..plans.shapes import utc

#: How far a stored double can lie from the value it is read as, by the catalog's type.
_SLACK = {"decimal": 0.005 * (1 + 1e-6), "integer": 1.0, "float": 0.0}
Bound = tuple[str, str, nodes.Literal | str]  # field, comparison, literal or ISO time in UTC


def bounds(operators: tuple[nodes.Operator, ...], scan: str) -> list[Bound]:
    """Comparisons that all rows of a scan must pass: those of the unbranched chain of filters above it."""
    users: dict[str, list[nodes.Operator]] = {}
    for o in operators:
        for i in o.inputs:
            users.setdefault(i, []).append(o)
    out: list[Bound] = []
    at = scan
    while len(users.get(at, [])) == 1:
        op = users[at][0]
        if isinstance(op, nodes.TemporalFilter):
            iso = lambda t: utc(t).strftime("%Y-%m-%d %H:%M:%S.%f")
            out += [(op.field, "ge", iso(op.start)), (op.field, "lt", iso(op.end))]
        elif isinstance(op, nodes.Filter):
            out += [(c.left.field, c.operator, c.right) for c in _conjuncts(op.expression)]
        elif not isinstance(op, nodes.SpatialFilter | nodes.Project):
            break
        at = op.operator_id
    return out


def _conjuncts(e: nodes.Comparison | nodes.BooleanGroup) -> Iterator[nodes.Comparison]:
    if isinstance(e, nodes.Comparison):
        if not e.negated:
            yield e
    elif e.operator == "and" and not e.negated:
        for c in e.operands:
            yield from _conjuncts(c)


def restrict(df: DataFrame, found: list[Bound], dataset: Dataset) -> DataFrame:
    """``df`` of stored columns under the bounds that apply to their types and to those that ``dataset`` reads them as."""
    stored = dict(df.dtypes)
    read_as = {f.name: f.data_type for f in dataset.fields}
    for name, comparison, value in found:
        condition = _condition(name, stored.get(name), read_as.get(name), comparison, value)
        if condition is not None:
            df = df.where(condition)
    return df


def _condition(name: str, kind: str | None, read_as: str | None, comparison: str, value: nodes.Literal | str) -> Column | None:
    c = column(name)
    if kind == "timestamp_ntz" and read_as == "datetime" and isinstance(value, str):
        bound = F.lit(value).cast("timestamp_ntz")
        return c >= bound if comparison == "ge" else c < bound
    if kind in ("double", "float") and read_as in _SLACK and isinstance(value, nodes.Literal) and value.data_type in ("decimal", "integer", "float"):
        v = float(value.value)
        # a float column's own rounding and the literal's are far below this
        slack = _SLACK[read_as] + abs(v) * (1e-6 if kind == "float" else 1e-12)
        low, high = c >= F.lit(v - slack), c <= F.lit(v + slack)
        return {"ge": low, "gt": low, "le": high, "lt": high, "eq": low & high}.get(comparison)
    return None
