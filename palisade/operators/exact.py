"""Exact sums of decimals that are stored as doubles, by long arithmetic.

Where the one who binds a table knows how many digits a decimal has, a sum over it or over a product of such fields needs no decimal
per row: values are hundredths in a long, products of them stay in a long, and sums are kept in parts of 21 bits, which hold
2**42 rows of a group before they overflow, which is an error and never a wrong sum.  The parts are put together once a group.

The hundredths ride from the scan to the aggregate in hidden columns, over filters and joins only; nothing else reads them, and
none is made where results are stored on the way.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..plans import nodes

_PREFIX = "__hundredths_"
_PART = 21


def hidden(name: str) -> str:
    return _PREFIX + name


def hundredths(name: str, digits: int) -> Column:
    """A stored double as hundredths, rounded half up as the cast to a decimal of ``digits`` digits does.

    Far from a tie the nearest whole number is that; near one, and beyond the digits, the cast decides.
    """
    c = column(name)
    near = F.rint(c * 100)
    plain = (F.abs(c * 100 - near) < 0.25) & (F.abs(near) < F.lit(float(10**digits)))
    return F.when(c.isNotNull(), F.when(plain, near.cast("bigint")).otherwise((c.cast(f"decimal({digits},2)") * 100).cast("bigint"))).alias(hidden(name))


def scans(operators: tuple[nodes.Operator, ...]) -> dict[str, set[str]]:
    """Fields that sums and averages read, by the scans that lie below their aggregate with filters and joins alone between."""
    known = {o.operator_id: o for o in operators}
    out: dict[str, set[str]] = {}
    for op in operators:
        if not isinstance(op, nodes.Aggregate):
            continue
        wanted = {f for a in op.aggregates if a.function in ("sum", "avg") for f in ((a.input_field,) if a.input_field else nodes.fields_of(a.input_expression))}
        todo = list(op.inputs)
        while todo:
            at = known[todo.pop()]
            if isinstance(at, nodes.ScanSource):
                out.setdefault(at.operator_id, set()).update(wanted)
            elif isinstance(at, nodes.Filter | nodes.TemporalFilter | nodes.SpatialFilter | nodes.Join):
                todo += at.inputs
    return out


def total(item: nodes.AggregateItem, have: set[str], digits: Mapping[str, int]) -> Column | None:
    """The sum of ``item`` if all its fields ride along and its products fit a long; else None."""
    if item.input_field:
        factors: list = [nodes.FieldRef("field", item.input_field)]
    elif isinstance(item.input_expression, nodes.Product):
        factors = [item.input_expression.left, item.input_expression.right]
    else:
        factors = list(item.input_expression.factors)
    value, most = None, 1
    for f in factors:
        name = f.field if isinstance(f, nodes.FieldRef) else f.field.field
        if hidden(name) not in have or name not in digits:
            return None
        x, bound = F.col(f"`{hidden(name)}`"), 10 ** digits[name]
        if isinstance(f, nodes.Affine):
            constant = Decimal(f.constant.value) * 100
            if constant != int(constant):
                return None
            x = F.lit(int(constant)).cast("bigint") + (x if f.operator == "add" else -x)
            bound += abs(int(constant))
        value, most = (x if value is None else value * x), most * bound
    if most >= 1 << 63:
        return None
    return _scaled_sum(value, most, 2 * len(factors))


def _scaled_sum(value: Column, most: int, scale: int) -> Column:
    wide = lambda c: F.sum(c).cast("decimal(38,0)")
    parts = -(-most.bit_length() // _PART)
    low = F.lit((1 << _PART) - 1).cast("bigint")
    out = None
    for i in range(parts):
        part = F.shiftright(value, _PART * i) if i else value
        part = part if i == parts - 1 else part.bitwiseAND(low)
        term = wide(part) * F.lit(Decimal(1 << (_PART * i))) if i else wide(part)
        out = term if out is None else out + term
    return out.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))
