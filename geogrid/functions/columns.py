"""Column expressions for years, coordinates, sentinels and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if(x: str | Column, sentinel: float) -> Column:
    """Missing where ``x`` holds the sentinel or NaN."""
    x = _c(x)
    return F.when((x == sentinel) | F.isnan(x.cast("double")), None).otherwise(x)


def near_flag(x: str | Column, limit: float = 2500.0) -> Column:
    """1 where ``x`` is below the limit, else 0; missing counts as far."""
    return F.coalesce((_c(x) < limit).cast("int"), F.lit(0))


def half_away(x: str | Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` as C and SQL engines do it: scaled, halves away from zero, scaled back. The sign stays,
    also of a zero, which Spark's decimal rounding loses."""
    x, scale = _c(x), F.lit(10.0**digits)
    return F.signum(x) * F.round(F.abs(x) * scale) / scale


def exists_at(year: Column, birth: Column, end: Column | None = None, lag: int = 0) -> Column:
    """A town exists in a year if it was founded before it and ended after it; without an end, if founded ``lag`` years before."""
    return (birth < year) & (end > year) if end is not None else birth <= year - lag


def century(birth: str | Column) -> Column:
    return F.ceil(_c(birth) / 100.0).cast("int")


def snap_mid(start: str | Column, end: str | Column) -> Column:
    """A window's middle, cut to a whole year and then down to a century; BCE years go down as well."""
    mid = F.when(_c(start) + _c(end) < 0, F.ceil((_c(start) + _c(end)) / 2.0)).otherwise(F.floor((_c(start) + _c(end)) / 2.0)).cast("int")
    return mid - F.pmod(mid, F.lit(100))


def calendar(ka: str | Column) -> Column:
    """Calendar year of a time in thousands of years relative to 1950."""
    return (1950 + 1000 * _c(ka)).cast("int")


def era(year: str | Column) -> Column:
    return F.when(_c(year) < 0, F.lit("BCE")).otherwise(F.lit("CE"))


def period_column(year: int, before: str = "pre", after: str = "post", turn: int = 1500) -> Column:
    """The column that holds for a year: ``before`` up to ``turn``, then ``after``."""
    return F.col(before if year <= turn else after)


def safe_name(x: str | Column) -> Column:
    """A file name with ``|``, ``?`` and ``*`` as hyphens."""
    return F.translate(_c(x), "|?*", "---")


def centroid(box: str | Column) -> tuple[Column, Column]:
    """Middle of a struct<minx,miny,maxx,maxy>."""
    b = _c(box)
    return (b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2


def upper_left(box: str | Column) -> tuple[Column, Column]:
    b = _c(box)
    return b["minx"], b["maxy"]


def lambert(lon: Column, lat: Column, lat1: float, lat2: float, lon0: float, lat0: float = 0.0, radius: float = 6378137.0) -> tuple[Column, Column]:
    """Lambert conformal conic projection on a sphere, in metres, from two standard parallels."""
    import math

    tan = lambda d: math.tan(math.pi / 4 + math.radians(d) / 2)
    a, b = math.radians(lat1), math.radians(lat2)
    n = math.sin(a) if lat1 == lat2 else math.log(math.cos(a) / math.cos(b)) / math.log(tan(lat2) / tan(lat1))
    f = math.cos(a) * tan(lat1) ** n / n
    rho0 = radius * f / tan(lat0) ** n
    rho = F.lit(radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(lon0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def rescaled(variable: Column, value: Column, kelvin: tuple[str, ...] = ("bio1", "bio8", "bio9")) -> Column:
    """Stored climate integers to units: a tenth, and for the named temperatures from Kelvin to Celsius."""
    return F.when(variable.isin(*kelvin), value * 0.1 - 273.15).otherwise(value * 0.1).cast("float")
