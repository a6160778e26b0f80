"""Colours of packages and their libraries, in single precision as the positions on screen are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hue of the first package, hue step (golden ratio), saturation, lightness alone and from first to last library.
FIRST_HUE, HUE_STEP, SATURATION, LIGHTNESS, DARKEST, LIGHTEST = 0.137, 0.618034, 0.55, 0.62, 0.48, 0.76


def _f(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("float")


def package_hue(index: Column) -> Column:
    turn = _f(FIRST_HUE) + _f(index) * _f(HUE_STEP)
    return _f(turn - F.floor(turn))


def _channel(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + _f(1)).when(t > 1, t - _f(1)).otherwise(t)
    rise, fall = p + (q - p) * _f(6) * t, p + (q - p) * (_f(2) / _f(3) - t) * _f(6)
    value = F.when(t < 1 / 6, rise).when(t < 0.5, q).when(t < 2 / 3, fall).otherwise(p)
    return F.least(F.greatest(F.floor(value * _f(255) + _f(0.5)), F.lit(0)), F.lit(255)).cast("int")


def rgb(hue: Column, lightness: Column) -> Column:
    """#rrggbb of a hue and a lightness at the fixed saturation."""
    s, light = _f(SATURATION), _f(lightness)
    q = F.when(light < 0.5, light * (_f(1) + s)).otherwise(light + s - light * s)
    p = _f(2) * light - q
    third = _f(1.0 / 3.0)
    parts = [_channel(p, q, hue + third), _channel(p, q, hue), _channel(p, q, hue - third)]
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in parts])


def package_color(index: Column) -> Column:
    return rgb(package_hue(index), F.lit(LIGHTNESS))


def lib_color(package_index: Column, lib_index: Column, lib_count: Column) -> Column:
    """Shades of the package's hue from dark to light; a single library has the package's colour."""
    share = _f(F.least(lib_index, lib_count - 1)) / _f(F.greatest(lib_count - 1, F.lit(1)))
    return F.when(lib_count <= 1, package_color(package_index)).otherwise(rgb(package_hue(package_index), _f(DARKEST) + share * (_f(LIGHTEST) - _f(DARKEST))))


# Colours of nodes without a package and of external ones.
PLAIN, OUTSIDE = "#6da7e8", "#78808c"
