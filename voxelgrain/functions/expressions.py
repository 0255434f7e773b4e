"""Scalar expressions, as Columns: guards, names, colours, directions, and the exact null percentile."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """``c``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def normalize_name(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def normal_name(text: str) -> str:
    """The same for one Python value."""
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


ENTITY_FILE = r"^(.*)_([a-z0-9_]+)_(labels?|mask)$"


def entity_file(stem: Column) -> Column:
    """Struct of prefix, name and kind of an entity's file stem; null if it isn't one. The prefix takes as much as it can."""
    name = normalize_name(stem)
    part = lambda i: F.regexp_extract(name, ENTITY_FILE, i)
    kind = F.when(part(3) == "mask", "mask").otherwise("label")
    return F.when(name.rlike(ENTITY_FILE), F.struct(part(1).alias("prefix"), part(2).alias("name"), kind.alias("kind")))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" + "), F.greatest(a, b))


def partner_key(entity: Column, label: Column) -> Column:
    """Null if the label is null, so that masks aren't counted as partners."""
    return F.concat(entity, F.lit(":"), label.cast("string"))


def hex_colour(c: Column) -> Column:
    """``#rrggbb`` in lower case; null for anything that is no hex colour."""
    low = F.lower(c)
    return F.when(low.rlike("^#[0-9a-f]{6}$"), low).when(low.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(low, "([0-9a-f])", "$1$1"))


def hex_colour_of(text: object) -> str:
    """The same for one Python value; raises for anything else."""
    if not isinstance(text, str) or not re.fullmatch("#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})", text):
        raise ValueError(f"not a hex colour: {text!r}")
    low = text.lower()
    return low if len(low) == 7 else "#" + "".join(x * 2 for x in low[1:])


def normalised(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` in its range, from 0 to 1; an empty range counts as one of width 1."""
    return (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))


#: Nine evenly spaced stops of the viridis colour map.
VIRIDIS = ("#440154", "#472d7b", "#3b528b", "#2c728e", "#21918c", "#28ae80", "#5ec962", "#addc30", "#fde725")
#: What has no finite value is drawn in this share of white.
GREY = 0.6


def viridis(t: Column) -> Column:
    """Struct of r, g and b by linear interpolation between the stops; null stays null."""
    n = len(VIRIDIS) - 1
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * n
    lower = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    stops = [F.array(*(F.lit(v) for v in channel)) for channel in zip(*map(channels_of, VIRIDIS), strict=True)]
    mix = lambda s: F.get(s, lower) + (F.get(s, lower + 1) - F.get(s, lower)) * (at - lower)
    return F.when(t.isNotNull(), F.struct(*(mix(s).alias(k) for s, k in zip(stops, "rgb", strict=True))))


def channels_of(colour: str) -> tuple[float, float, float]:
    """Red, green and blue of a hex colour, from 0 to 1."""
    red, green, blue = (int(colour[k : k + 2], 16) / 255 for k in (1, 3, 5))
    return red, green, blue


def metric_colour(value: Column, low: Column, high: Column) -> Column:
    """Struct of r, g and b for a value in its range; grey where it isn't finite."""
    return F.coalesce(viridis(normalised(finite(value), low, high)), F.struct(*(F.lit(GREY).alias(k) for k in "rgb")))


def explode_offset(dist: Column, direction: tuple[Column, Column, Column], factor: Column) -> Column:
    """Array (x, y, z): direction times distance times factor; zeros if any is missing or zero."""
    zero = F.coalesce(dist, F.lit(0.0)) * F.coalesce(factor, F.lit(0.0)) == 0
    return F.array(*(F.when(zero, F.lit(0.0)).otherwise(F.coalesce(n, F.lit(0.0)) * dist * factor) for n in direction))


def group_of(folder: Column, paths: list[str]) -> Column:
    """The first of ``paths`` that is the folder or holds it; else the first part of a nested relative path; else empty."""
    hits = [F.when((folder == p) | folder.startswith(p.rstrip("/") + "/"), F.lit(p)) for p in paths]
    nested = F.when(F.contains(folder, F.lit("/")), F.split(folder, "/")[0])
    return F.coalesce(*hits, nested, F.lit(""))


def direction(dz: Column, dy: Column, dx: Column) -> Column:
    """Struct: distance, unit vector (null at distance 0), azimuth and elevation in degrees."""
    d = F.sqrt(dz * dz + dy * dy + dx * dx)
    unit = lambda c: F.when(d > 0, c / d)
    el = F.asin(clamp_unit(unit(dz)))
    return F.struct(d.alias("dist"), unit(dz).alias("nz"), unit(dy).alias("ny"), unit(dx).alias("nx"), F.when(d > 0, F.degrees(F.atan2(dy, dx))).alias("az_deg"), F.degrees(el).alias("el_deg"))


def direction_2d(dy: Column, dx: Column) -> Column:
    d = F.sqrt(dy * dy + dx * dx)
    return F.struct(d.alias("dist"), F.when(d > 0, dy / d).alias("ny"), F.when(d > 0, dx / d).alias("nx"), F.when(d > 0, F.degrees(F.atan2(dy, dx))).alias("angle_deg"))


def survival(n: Column, r: Column, k: Column) -> Column:
    """Share of the k-element subsets of n that avoid r given elements: 0 as soon as there are too few others."""
    step = lambda acc, j: acc * F.greatest(n - r - j, F.lit(0)) / (n - j)
    return F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(1.0), step)


def null_percentile(n: Column, k: Column, below: Column, upto: Column) -> Column:
    """Percentage of random groups of ``k`` out of ``n`` whose least value is larger than the observed one, ties half.

    ``below`` and ``upto`` count the pool's values that are smaller, and not larger, than the observed one.
    """
    return F.when((n > 0) & (k > 0) & (k < n), 50.0 * (survival(n, upto, k) + survival(n, below, k)))


def clamp_unit(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def roundness_3d(volume: Column, surface: Column) -> Column:
    """Surface of the ball of equal volume over the surface."""
    return F.when(surface > 0, F.pow(F.lit(3.141592653589793), F.lit(1 / 3)) * F.pow(6.0 * volume, F.lit(2 / 3)) / surface)


def roundness_2d(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 2.0 * F.sqrt(F.lit(3.141592653589793) * area) / perimeter)


def smoothing(roundness: Column, fill: Column, low: float = 0.3, high: float = 1.5) -> Column:
    """Smoothing width by shape; the middle of the range if the shape is unknown."""
    full = F.least(F.lit(1.0), fill / F.lit(3.141592653589793 / 6))
    share = F.sqrt(F.greatest(roundness, F.lit(0.0)) * F.greatest(full, F.lit(0.0)))
    return F.coalesce(F.lit(low) + (high - low) * F.least(share, F.lit(1.0)), F.lit((low + high) / 2))


def all_of(parts: list[Column]) -> Column:
    """Conjunction of filters; true for none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def maybe_int(c: Column) -> Column:
    """A whole number from a number or its text; null for nothing, an empty text, and what isn't finite or a number."""
    return finite(c.cast("string").try_cast("double")).cast("long")


def payload_count(payload: Column, index: int) -> Column:
    """The 32-bit little-endian count at ``index`` (0 or 1) of a payload's header; null if there is no header."""
    four = F.reverse(F.hex(F.substring(payload, index * 4 + 1, 4)))
    # Reversing the hex digits also swaps the two digits of each byte, so they are swapped back.
    swapped = F.regexp_replace(four, "(.)(.)", "$2$1")
    return F.when(F.octet_length(payload) >= 8, F.conv(swapped, 16, 10).cast("long"))
