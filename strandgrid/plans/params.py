"""Search parameters by the rate of differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: {(dimensions, k): {edits: coarse radius}}; -1 for all other numbers of edits.
COARSE_RADIUS = {
    (8, 64): {
        0: 0.001000, 1: 0.012450, 2: 0.033463, 3: 0.047159, 4: 0.047159, 5: 0.047159, 6: 0.051325, 7: 0.051325, 8: 0.055019, 9: 0.055019,
        10: 0.055019, 11: 0.055275, 12: 0.063451, 13: 0.063451, 14: 0.063451, 15: 0.071191, 16: 0.071191, 17: 0.071191, 18: 0.071191, 19: 0.071191,
        20: 0.091198, 21: 0.091198, 22: 0.091198, 24: 0.091198, 25: 0.091198, 26: 0.091198, 27: 0.091198, 28: 0.128071, 29: 0.147524,
        30: 0.151455, 31: 0.162224, 32: 0.194233, 33: 0.194233, 34: 0.194233, 35: 0.214527, 36: 0.235639, 37: 0.235639, 38: 0.237776, 39: 0.247015,
        40: 0.247015, 41: 0.272538, 42: 0.281231, 43: 0.296970, -1: 0.3,
    },
}

# Fixed values: {(sub-k, k): {edits: least overlap}}; -1 for all other numbers of edits.
FILTER_OVERLAP = {
    (6, 64): {
        0: 0.950000, 1: 0.851724, 2: 0.753448, 3: 0.655172, 4: 0.573276, 5: 0.499153, 6: 0.450847, 7: 0.450847, 8: 0.386441, 9: 0.305932,
        10: 0.229310, 11: 0.193220, 12: 0.177119, 13: 0.177119, 14: 0.177119, 15: 0.144915, 16: 0.144915, 17: 0.144915, 18: 0.144915, 19: 0.144915,
        21: 0.064407, 22: 0.064407, 23: 0.016102, 24: 0.016102, 25: 0.016102, 26: 0.016102, 27: 0.000000, -1: 0.000000,
    },
    (7, 64): {
        0: 0.950000, 1: 0.835345, 2: 0.720690, 3: 0.606034, 4: 0.491379, 5: 0.433333, 6: 0.409483, 7: 0.360345, 8: 0.327586, 9: 0.245690,
        10: 0.147414, 11: 0.114655, 12: 0.098276, 13: 0.098276, 14: 0.098276, 15: 0.065517, 16: 0.065517, 17: 0.065517, 18: 0.065517, 19: 0.065517,
        20: 0.016379, 21: 0.016379, 22: 0.016379, 23: 0.000000, -1: 0.000000,
    },
}


def _pick(tables: dict, key: tuple[int, int], rate: Column | str | float, k: int) -> Column:
    if key not in tables:
        raise KeyError(f"no values for {key}; there are {sorted(tables)}")
    rate = F.col(rate) if isinstance(rate, str) else F.lit(rate) if isinstance(rate, (int, float)) else rate
    rows = tables[key]
    table = F.create_map(*[F.lit(x) for e, r in rows.items() if e >= 0 for x in (e, r)])
    return F.coalesce(F.try_element_at(table, F.ceil(rate * k).cast("int")), F.lit(rows[-1]))


def coarse_radius(rate: Column | str | float, d: int = 8, k: int = 64) -> Column:
    """Coarse search radius for a rate of differences."""
    return _pick(COARSE_RADIUS, (d, k), rate, k)


def min_filter_overlap(rate: Column | str | float, sub_k: int = 7, k: int = 64) -> Column:
    """Least share of windows that the filter asks for, for a rate of differences."""
    return _pick(FILTER_OVERLAP, (sub_k, k), rate, k)
