"""Plan expressions, masks, distances and grids as columns."""

from __future__ import annotations

import functools
import operator
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import fixed, nodes
from ..plans.shapes import utc

SPARK_TYPE = {"string": "string", "integer": "bigint", "float": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "datetime": "timestamp"}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: nodes.Literal) -> Column:
    v = value.value
    if value.data_type == "decimal":
        d = Decimal(v)
        scale = max(0, -d.as_tuple().exponent)
        return F.lit(d).cast(f"decimal({max(len(d.as_tuple().digits), scale) + 1},{scale})")
    if value.data_type == "datetime":
        return instant(datetime.fromisoformat(v.replace("Z", "+00:00")))
    return F.lit(v).cast(SPARK_TYPE[value.data_type])


def instant(v: datetime) -> Column:
    return F.lit(utc(v).strftime("%Y-%m-%d %H:%M:%S.%f") + "+00:00").cast("timestamp")


_COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}


def predicate(e: nodes.Comparison | nodes.BooleanGroup) -> Column:
    """Three-valued, as in SQL; negation of unknown is unknown."""
    if isinstance(e, nodes.Comparison):
        out = _COMPARE[e.operator](column(e.left.field), literal(e.right))
    else:
        out = functools.reduce(operator.and_ if e.operator == "and" else operator.or_, map(predicate, e.operands))
    return ~out if e.negated else out


def numeric(e: nodes.Product | nodes.Formula) -> Column:
    if isinstance(e, nodes.Product):
        return column(e.left.field) * column(e.right.field)
    return functools.reduce(operator.mul, map(_factor, e.factors))


def _factor(f: nodes.FieldRef | nodes.Affine) -> Column:
    if isinstance(f, nodes.FieldRef):
        return column(f.field)
    return literal(f.constant) + column(f.field.field) if f.operator == "add" else literal(f.constant) - column(f.field.field)


def masked(c: Column, method: str, data_type: str) -> Column:
    """A token for any value, nulls too; the lowercase SHA-256 of a string; or a null of the type."""
    if method == "redact":
        return F.lit(fixed.REDACTED)
    return F.sha2(c.cast("string"), 256) if method == "hash" else F.lit(None).cast(SPARK_TYPE[data_type])


def grid_centre(c: Column, precision_km: float, offset: float) -> Column:
    """Centre of the cell of ``precision_km`` that a coordinate lies in."""
    side = precision_km / fixed.KM_PER_DEGREE
    return F.floor((c + F.lit(offset)) / F.lit(side)) * F.lit(side) - F.lit(offset) + F.lit(side / 2)


def planar_km(lat: Column, lon: Column, centre: tuple[float, float]) -> Column:
    """Equirectangular distance from a centre (latitude, longitude)."""
    x = (lon - F.lit(centre[1])) * F.cos(F.radians(F.lit(centre[0])))
    return F.lit(fixed.KM_PER_DEGREE) * F.sqrt(F.pow(lat - F.lit(centre[0]), F.lit(2.0)) + F.pow(x, F.lit(2.0)))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on the sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # not least(): it passes over nulls, and a null coordinate has no distance
    return F.lit(2 * fixed.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))
