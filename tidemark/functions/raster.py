"""Pixel algebra on Columns. An invalid observation is NULL and stays NULL through every expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(x: Column, scale: float = 1e4) -> Column:
    """x as a whole number of 1/scale, halves up: what engines agree on."""
    return F.floor(x * F.lit(float(scale)) + 0.5).cast("bigint")


def valid(x: Column, nodata: float | None = None) -> Column:
    """x where it is finite and not the nodata value."""
    x = x.cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok & (x != nodata) if nodata is not None else ok, x)


def with_nodata(x: Column, nodata: float) -> Column:
    return F.coalesce(x, F.lit(nodata))


def difference(post: Column, pre: Column) -> Column:
    return post - pre


def to_db(x: Column) -> Column:
    """10 log10 of positive values only."""
    return 10 * F.log10(F.when(x > 0, x))


def log_ratio_db(post: Column, pre: Column) -> Column:
    """10 log10(post / pre) where both are positive."""
    return 10 * F.log10(F.when((post > 0) & (pre > 0), F.try_divide(post, pre)))


def cross_polarisation_db(co: Column, cross: Column) -> Column:
    return co - cross


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL where the sum is zero."""
    return F.try_divide(a - b, a + b)


def reflectance(x: Column, scale: float, offset: float) -> Column:
    return x * scale + offset


def clipped(x: Column, most: float = 0.15) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(most)))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Standard score with invalid pixels at the mean, which is zero."""
    return F.coalesce(F.try_divide(x - mean, std), F.lit(0.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


#: Transforms of pixels by name; the slope of a surface needs neighbours and is focal.horn_slope().
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "passthrough": lambda a: a,
    "difference": difference,
    "log_ratio_db": log_ratio_db,
    "cross_pol_difference_db": cross_polarisation_db,
    "normalized_difference": normalized_difference,
    "derived_difference": difference,
}


@dataclass(frozen=True)
class Template:
    """A kind of feature: its inputs (artifact, band role) or the features it is made of, and what it may look like.

    {role} stands for each polarisation or each spectral band that is configured. linear is the transform where
    backscatter comes as linear power instead of decibels."""

    name: str
    transform: str
    inputs: tuple[tuple[str, str], ...] = ()
    linear: str | None = None
    per: str | None = None
    span: tuple[float, float] | None = None
    derived_from: tuple[str, ...] = ()


_S1, _S2 = ("sentinel1_before", "sentinel1_after"), ("sentinel2_before", "sentinel2_after")


def _both(role: str) -> tuple[tuple[str, str], ...]:
    return (_S2[1], role), (_S2[0], role)


#: Feature templates in the order in which features are written. Fixed values.
TEMPLATES: dict[str, Template] = {
    "s1_backscatter_pre": Template("s1_{role}_pre", "passthrough", ((_S1[0], "{role}"),), "passthrough", "polarisation"),
    "s1_backscatter_post": Template("s1_{role}_post", "passthrough", ((_S1[1], "{role}"),), "passthrough", "polarisation"),
    "s1_change_db": Template("s1_{role}_change_db", "difference", ((_S1[1], "{role}"), (_S1[0], "{role}")), "log_ratio_db", "polarisation"),
    "s1_co_cross_ratio_db_pre": Template("s1_vv_vh_ratio_db_pre", "cross_pol_difference_db", ((_S1[0], "vv"), (_S1[0], "vh")), "log_ratio_db"),
    "s1_co_cross_ratio_db_post": Template("s1_vv_vh_ratio_db_post", "cross_pol_difference_db", ((_S1[1], "vv"), (_S1[1], "vh")), "log_ratio_db"),
    "s2_reflectance_pre": Template("s2_{role}_pre", "passthrough", ((_S2[0], "{role}"),), None, "band", (0.0, 1.0)),
    "s2_reflectance_post": Template("s2_{role}_post", "passthrough", ((_S2[1], "{role}"),), None, "band", (0.0, 1.0)),
    "s2_reflectance_change": Template("s2_{role}_change", "difference", _both("{role}"), None, "band", (-1.0, 1.0)),
    "s2_ndwi_pre": Template("s2_ndwi_pre", "normalized_difference", ((_S2[0], "green"), (_S2[0], "nir")), span=(-1.0, 1.0)),
    "s2_ndwi_post": Template("s2_ndwi_post", "normalized_difference", ((_S2[1], "green"), (_S2[1], "nir")), span=(-1.0, 1.0)),
    "s2_ndwi_change": Template("s2_ndwi_change", "derived_difference", span=(-2.0, 2.0), derived_from=("s2_ndwi_post", "s2_ndwi_pre")),
    "s2_mndwi_pre": Template("s2_mndwi_pre", "normalized_difference", ((_S2[0], "green"), (_S2[0], "swir16")), span=(-1.0, 1.0)),
    "s2_mndwi_post": Template("s2_mndwi_post", "normalized_difference", ((_S2[1], "green"), (_S2[1], "swir16")), span=(-1.0, 1.0)),
    "s2_mndwi_change": Template("s2_mndwi_change", "derived_difference", span=(-2.0, 2.0), derived_from=("s2_mndwi_post", "s2_mndwi_pre")),
    "s2_ndvi_pre": Template("s2_ndvi_pre", "normalized_difference", ((_S2[0], "nir"), (_S2[0], "red")), span=(-1.0, 1.0)),
    "s2_ndvi_post": Template("s2_ndvi_post", "normalized_difference", ((_S2[1], "nir"), (_S2[1], "red")), span=(-1.0, 1.0)),
    "s2_ndvi_change": Template("s2_ndvi_change", "derived_difference", span=(-2.0, 2.0), derived_from=("s2_ndvi_post", "s2_ndvi_pre")),
    "dem_elevation": Template("dem_elevation", "passthrough", (("dem", "elevation"),)),
    "dem_slope_degrees": Template("dem_slope_degrees", "slope_horn_degrees", (("dem", "elevation"),), span=(0.0, 90.0)),
}


@dataclass(frozen=True)
class Feature:
    name: str
    template: str
    transform: str
    inputs: tuple[str, ...]
    span: tuple[float, float] | None


def feature_plan(enabled: Sequence[str], bindings: dict[str, dict[str, str]], polarisations: Sequence[str] = (), bands: Sequence[str] = (), decibels: bool | None = None) -> list[Feature]:
    """The features that templates stand for, with their input columns: templates in their own order, roles in the
    order given, and features made of others last.

    bindings: for each artifact the column of each band role. decibels: whether backscatter comes as decibels or as
    linear power, which decides the arithmetic and has no default. Nothing enabled, an unknown template, roles that a
    template needs and that aren't given or bound, an unset representation, a base feature that isn't enabled, and two
    features of one name are errors."""
    unknown = [t for t in enabled if t not in TEMPLATES]
    if unknown or not enabled:
        raise ValueError(f"unknown feature templates {unknown}" if unknown else "no feature is enabled")
    base, derived = [], []
    for key, t in TEMPLATES.items():
        if key not in enabled:
            continue
        roles = {"polarisation": polarisations, "band": bands, None: ("",)}[t.per]
        if not roles:
            raise ValueError(f"{key} needs the {t.per} roles")
        radar = any(artifact in _S1 for artifact, _ in t.inputs)
        if radar and decibels is None:
            raise ValueError(f"{key} needs to know whether backscatter is in decibels")
        for role in roles:
            inputs = []
            for artifact, slot in t.inputs:
                name = bindings.get(artifact, {}).get(slot.replace("{role}", role))
                if name is None:
                    raise ValueError(f"{key}: {slot.replace('{role}', role)} of {artifact} is not bound to a column")
                inputs.append(name)
            transform = t.linear if radar and not decibels and t.linear else t.transform
            of = [x.replace("{role}", role) for x in t.derived_from]
            (derived if of else base).append(Feature(t.name.replace("{role}", role), key, transform, tuple(of or inputs), t.span))
    every = [*base, *derived]
    names = [f.name for f in every]
    lacking = [(f.name, x) for f in derived for x in f.inputs if x not in names]
    if lacking or len(set(names)) < len(names):
        raise ValueError(f"{lacking[0][0]} is made of {lacking[0][1]}, which isn't enabled" if lacking else "two features have one name")
    return every


def feature_columns(plan: Sequence[Feature]) -> dict[str, Column]:
    """A Column for each feature of a plan, in its order; a slope is read from a column of the feature's name."""
    out: dict[str, Column] = {}
    for f in plan:
        if f.transform in TRANSFORMS:
            given = [out[i] if f.transform == "derived_difference" else F.col(i) for i in f.inputs]
            out[f.name] = TRANSFORMS[f.transform](*given)
        else:
            out[f.name] = F.col(f.name)
    return out
