"""Column functions on digital numbers, reflectance, indexes, classes and masks. Invalid is NULL throughout."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelweft.schemas import CLASS_NAMES, DN_SCALE, NO_CHANGE_DATA, STRICT


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """x, or NULL where it is NaN or infinite."""
    x = col(x)
    return F.when(~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")), x)


def clean_dn(dn: Column | str, nodata: Column | float = 0) -> Column:
    """dn, or NULL where it is not finite, negative or nodata."""
    x = col(dn).cast("double")
    nodata = nodata if isinstance(nodata, Column) else F.lit(nodata)
    # NaN is greater than infinity
    return F.when((x >= 0) & (x < float("inf")) & ~x.eqNullSafe(nodata.cast("double")), x)


def reflectance(dn: Column | str, scale: float = DN_SCALE) -> Column:
    """dn / scale within [0, 1]; NULL stays NULL."""
    x = col(dn).cast("double") / scale
    return F.when(x > 1, 1.0).when(x < 0, 0.0).otherwise(x)


def eight_bit(v: Column | str) -> Column:
    return reflectance(v, 255.0)


def class_name(code: Column | str) -> Column:
    code = col(code)
    names = F.create_map(*(F.lit(x) for item in CLASS_NAMES.items() for x in item))
    return F.coalesce(names[code.cast("int")], F.concat(F.lit("unknown_class_"), code.cast("int").cast("string")))


def usable_class(code: Column | str, classes: Iterable[int] = STRICT) -> Column:
    """Strict membership: fractional, unknown, NaN and NULL codes are not usable."""
    classes = sorted(set(classes))
    if not classes:
        raise ValueError("no usable class is given")
    return F.coalesce(col(code).cast("double").isin([float(c) for c in classes]), F.lit(False))


def class_code(x: Column | str) -> Column:
    """A raw class value, rounded and held within 0..255; missing is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.coalesce(finite(col(x).cast("double")), F.lit(0.0))))).cast("int")


def masked(x: Column | str, valid: Column | str) -> Column:
    return F.when(col(valid), col(x))


def ndvi(nir: Column | str, red: Column | str, valid: Column | str | None = None, eps: float = 1e-6) -> Column:
    """(nir - red) / (nir + red) within [-1, 1]; NULL where an input is, or the sum is as good as 0."""
    nir, red = col(nir), col(red)
    total = nir + red
    ok = F.abs(total) > eps
    if valid is not None:
        ok = ok & col(valid)
    x = (nir - red) / F.when(ok, total)
    return F.when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x)


def difference(before: Column | str, after: Column | str) -> Column:
    return col(after) - col(before)


def annotation(v: Column | str) -> Column:
    return (col(v) > 127).cast("int")


def change_mask(prob: Column | str, valid: Column | str, threshold: float) -> Column:
    """1 where the probability is over the threshold, 0 where not, 255 where it can't be told."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    prob = col(prob)
    return F.when(~F.coalesce(col(valid), F.lit(False)) | prob.isNull(), NO_CHANGE_DATA).when(prob > threshold, 1).otherwise(0)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def all_present(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """num / den, 0.0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.round(num / F.when(den != 0, den), digits))


def bbox_wkt(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    a, b, c, d = (col(x).cast("string") for x in (minx, miny, maxx, maxy))
    corner = lambda x, y: F.concat(x, F.lit(" "), y)
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", corner(a, b), corner(c, b), corner(c, d), corner(a, d), corner(a, b)), F.lit("))"))


def bbox_area_km2(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    """Equirectangular area of a box in degrees, whatever the order of its corners."""
    a, b, c, d = (col(x) for x in (minx, miny, maxx, maxy))
    return F.round(F.abs((c - a) * 111.32 * F.cos(F.radians((b + d) / 2)) * ((d - b) * 110.574)), 4)
