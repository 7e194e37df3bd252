"""Scene classification codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code -> (name, category).
CLASSES = {
    0: ("no_data", "no_data"),
    1: ("saturated_or_defective", "no_data"),
    2: ("cast_shadow", "cloud_shadow"),
    3: ("cloud_shadow", "cloud_shadow"),
    4: ("vegetation", "valid"),
    5: ("not_vegetated", "valid"),
    6: ("water", "valid"),
    7: ("unclassified", "valid"),
    8: ("cloud_medium_probability", "cloud"),
    9: ("cloud_high_probability", "cloud"),
    10: ("thin_cirrus", "cirrus"),
    11: ("snow_or_ice", "snow_ice"),
}
OBSERVABLE = (4, 5, 6, 7)


def category(code: Column) -> Column:
    """The code's category, `unexpected` for a code outside the table."""
    table = F.create_map(*[F.lit(x) for k, (_, c) in CLASSES.items() for x in (k, c)])
    return F.coalesce(table[code], F.lit("unexpected"))


def observable(code: Column) -> Column:
    return code.isin(*OBSERVABLE)
