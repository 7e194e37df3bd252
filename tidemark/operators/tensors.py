"""Samples for a model: channels in a fixed order, targets with ignored pixels, and turns that all of a sample share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import seeded_order

#: The order of channels: epoch and polarisation.
CHANNELS = (("pre", "vv"), ("pre", "vh"), ("post", "vv"), ("post", "vh"))
#: Dry, permanent water, flood; and what a pixel without a label is trained as.
SEMANTIC, IGNORED = (0, 1, 2), 3


def channel_stack(planes: DataFrame, keys: Sequence[str] = ("sample", "row", "col"), channels: Sequence[tuple[str, str]] = CHANNELS) -> DataFrame:
    """keys and a column per channel (role_polarisation, in order) of planes: keys, role, polarisation, value.

    One aggregation over the keys. An invalid pixel is a NULL value in a row that is there: a pixel without a row of some
    channel, or with two, is an error when it is read, as a scene that is missing must not pass for one that is
    invalid. Other roles and polarisations are not looked at."""
    is_of = lambda r, p: (F.col("role") == r) & (F.lower("polarisation") == p)
    wanted = planes.where(F.array_contains(F.array(*[F.lit(f"{r}/{p}") for r, p in channels]), F.concat_ws("/", "role", F.lower("polarisation"))))
    every = wanted.groupBy(*keys).agg(*[F.count_if(is_of(r, p)).alias(f"n_{r}_{p}") for r, p in channels], *[F.max(F.when(is_of(r, p), F.col("value"))).alias(f"{r}_{p}") for r, p in channels])
    told = lambda r, p: F.concat(F.lit("pixel "), F.concat_ws(", ", *keys), F.lit(": "), F.col(f"n_{r}_{p}").cast("string"), F.lit(f" rows of {r}/{p}"))
    once = lambda r, p: F.when(F.col(f"n_{r}_{p}") == 1, F.col(f"{r}_{p}")).otherwise(F.raise_error(told(r, p)).cast("double"))
    return every.select(*keys, *[once(r, p).alias(f"{r}_{p}") for r, p in channels])


def target(label: Column, valid: Column, semantic: Sequence[int] = SEMANTIC, ignored: int = IGNORED) -> Column:
    """The label where valid, else the ignored one; a valid pixel with a label of no meaning is an error."""
    known = F.coalesce(label.isin(*semantic), F.lit(False))
    told = F.concat(F.lit("valid pixel with label "), F.coalesce(label.cast("string"), F.lit("NULL")))
    return F.when(~F.coalesce(valid, F.lit(False)), ignored).when(known, label.cast("int")).otherwise(F.raise_error(told).cast("int"))


def turned(row: Column, col: Column, height: Column, width: Column, across: Column, down: Column, turns: Column) -> tuple[Column, Column]:
    """Where a pixel goes: mirrored left to right (across), top to bottom (down), then turned by quarter turns against
    the clock, in this order. After an odd number of turns the sample is width high and height wide."""
    c, r = F.when(across, width - 1 - col).otherwise(col), F.when(down, height - 1 - row).otherwise(row)
    to_row = F.when(turns == 1, width - 1 - c).when(turns == 2, height - 1 - r).when(turns == 3, c).otherwise(r)
    to_col = F.when(turns == 1, r).when(turns == 2, width - 1 - c).when(turns == 3, height - 1 - r).otherwise(c)
    return to_row, to_col


def augmented(pixels: DataFrame, sample: str, height: Column, width: Column, seed: str, across: bool = True, down: bool = True, rotate: bool = True) -> DataFrame:
    """pixels with row and col moved as their sample is turned: one draw per sample and seed, from a digest of both, so
    that channels, target and validity move alike, an epoch's seed draws anew, and reruns and lost tasks agree.

    No shuffle: each row finds its place by itself. Rows without a sample, row or col keep a NULL place."""
    digit = F.conv(F.substring(seeded_order(seed, F.col(sample)), 1, 1), 16, 10).cast("int")
    draw = lambda on, value: value if on else F.lit(0)
    row, col = turned(F.col("row"), F.col("col"), height, width, draw(across, digit % 2) == 1, draw(down, F.shiftright(digit, 1) % 2) == 1, draw(rotate, F.shiftright(digit, 2)))
    return pixels.withColumns({"row": row, "col": col})
