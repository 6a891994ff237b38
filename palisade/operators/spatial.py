"""Distance joins without comparing all pairs.

Latitude bands as high as the distance make it an equality join: a pair within the distance lies in the same band or in
neighbouring ones, so the right side is repeated over three bands.  Bands are cut by longitude too where that is
sound: within the distance of latitude ``a`` a longitude differs by at most ``asin(sin(d)/cos(a))``, so cells get wider towards
the poles; near a pole, where no bound holds, a band is one cell.  The exact distance decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column, great_circle_km
from ..plans import fixed

_SLACK = 1 + 1e-9


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(height)).cast("long")


def _cells(band: Column, angle: float, height: float) -> Column:
    """Cells around the globe in a band, each at least as wide as any longitude difference within the distance.

    The bound is taken at the band's edge nearest a pole with one band to spare, as partners come from a band away.
    """
    top = F.greatest(F.abs(band * F.lit(height) - 90.0), F.abs((band + 1) * F.lit(height) - 90.0)) + F.lit(height)
    sine = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(F.least(top, F.lit(90.0))))
    wide = F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * F.lit(_SLACK)
    usable = (top < 89.0) & (sine < 1.0) & F.lit(angle < math.pi / 4)
    return F.when(usable, F.greatest(F.floor(F.lit(360.0) / wide), F.lit(1))).otherwise(F.lit(1)).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    turned = lon - F.floor(lon / 360.0) * 360.0
    return F.least(F.floor(turned / 360.0 * cells), cells - 1).cast("long")


def within(left: DataFrame, right: DataFrame, left_fields: tuple[str, str], right_fields: tuple[str, str], km: float) -> DataFrame:
    """Pairs of rows at most ``km`` apart on the sphere; a null coordinate matches nothing.

    Bands hold what the sphere's latitude bound allows, so results equal those of comparing all pairs.  A crowded cell is
    one join key: adaptive execution splits it, as nothing else needs the key's rows together.
    """
    angle = km / fixed.EARTH_RADIUS_KM
    height = math.degrees(angle) * _SLACK
    (la, lo), (ra, ro) = ([column(n) for n in names] for names in (left_fields, right_fields))
    band = _band(la, height)
    l = left.where(la.isNotNull() & lo.isNotNull()).withColumns({"_band": band})
    l = l.withColumn("_cell", _cell(lo, _cells(F.col("_band"), angle, height)))
    r = right.where(ra.isNotNull() & ro.isNotNull()).withColumn("_b", F.explode(F.array(*[_band(ra, height) + F.lit(k) for k in (-1, 0, 1)])))
    # the cell is counted in the left row's band; with fewer than three cells a neighbour may come up twice
    r = r.withColumn("_n", _cells(F.col("_b"), angle, height)).withColumn("_c", _cell(ro, F.col("_n")))
    around = F.array_distinct(F.array(*[F.pmod(F.col("_c") + F.lit(k), F.col("_n")) for k in (-1, 0, 1)]))
    r = r.withColumn("_c", F.explode(around)).drop("_n")
    near = F.abs(ra - la) <= F.lit(height)
    joined = l.join(r, (F.col("_band") == F.col("_b")) & (F.col("_cell") == F.col("_c")) & near & (great_circle_km(la, lo, ra, ro) <= F.lit(km)))
    return joined.drop("_band", "_cell", "_b", "_c")


def within_by_all_pairs(left: DataFrame, right: DataFrame, left_fields: tuple[str, str], right_fields: tuple[str, str], km: float) -> DataFrame:
    """The definition, for tests on small tables."""
    (la, lo), (ra, ro) = ([column(n) for n in names] for names in (left_fields, right_fields))
    return left.join(right, great_circle_km(la, lo, ra, ro) <= F.lit(km))
