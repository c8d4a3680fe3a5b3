"""Strike-zone region ("attack zone") classifier.

Horizontal position is measured in inches from the middle of the plate;
vertical position as a percentage of the half-zone height, measured from
the zone middle, using the lower half-height below the middle and the
upper half-height above it.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColOrName, col

# --- fixed values: region limits (inches for x, percent of half-zone for z)
HEART_X = 6.7
SHADOW_X = 13.3
WASTE_X = 13.3 + 6.6
HEART_PCT = 67.0
SHADOW_PCT = 133.0
WASTE_PCT = 200.0
ZONES = ["Heart", "Shadow", "Chase", "Waste"]

_INF = float("inf")


def _div_r(num: Column, den: Column) -> Column:
    """Division with IEEE results at a zero denominator (+-inf, NaN -> NULL).

    A NaN percentage compares as unknown, which is what NULL does in the
    case chain below.
    """
    return (F.when(den != 0, num / den)
             .when(num > 0, F.lit(_INF))
             .when(num < 0, F.lit(-_INF)))


def vertical_pct(plate_z: ColOrName, sz_top: ColOrName, sz_bot: ColOrName,
                 unit_scale: float = 12.0) -> Column:
    z = col(plate_z) * unit_scale
    top = col(sz_top) * unit_scale
    bot = col(sz_bot) * unit_scale
    mid = (top + bot) / 2
    return F.when(z <= mid, _div_r(z - mid, mid - bot) * 100) \
            .otherwise(_div_r(z - mid, top - mid) * 100)


def attack_zone(plate_x: ColOrName, plate_z: ColOrName, sz_top: ColOrName,
                sz_bot: ColOrName, unit_scale: float = 12.0) -> Column:
    """Heart / Shadow / Chase / Waste for one pitch (inputs in feet).

    Missing coordinates fall through to 'Chase' unless the known
    coordinate alone puts the pitch in 'Waste'.
    """
    x = col(plate_x) * unit_scale
    p = vertical_pct(plate_z, sz_top, sz_bot, unit_scale)
    heart = (F.abs(x) <= HEART_X) & (F.abs(p) <= HEART_PCT)
    in_x = (x >= -SHADOW_X) & (x <= SHADOW_X)
    in_p = (p >= -SHADOW_PCT) & (p <= SHADOW_PCT)
    shadow = (in_x & in_p) & ((x > HEART_X) | (x < -HEART_X)
                              | (p > HEART_PCT) | (p < -HEART_PCT))
    waste = (x < -WASTE_X) | (x > WASTE_X) | (p > WASTE_PCT) | (p < -WASTE_PCT)
    return (F.when(heart, "Heart").when(shadow, "Shadow")
             .when(waste, "Waste").otherwise("Chase"))
