"""Scalar column builders. Missing numbers are NULL; denominators have the floors named in each function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
#: Ratios of train, validation and test.
SPLIT_RATIOS = (0.8, 0.1, 0.1)
CF_EDGES = (0.2, 0.6)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def wrap_angle(c: Column) -> Column:
    """To [-pi, pi)."""
    half = F.lit(TWO_PI / 2)
    return F.pmod(c + half, F.lit(TWO_PI)) - half


def heading(dx: Column, dy: Column, vx: Column, vy: Column) -> Column:
    """Direction of a step, or of the velocity where the step is shorter than 1e-6."""
    return F.when(norm2(dx, dy) < 1e-6, F.atan2(vy, vx)).otherwise(F.atan2(dy, dx))


def thw_soft(d: Column, v: Column) -> Column:
    return d / (v + 1e-3)


def thw_floor(d: Column, v: Column, floor: float) -> Column:
    return d / F.greatest(v, F.lit(floor))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def sanitized_gap(c: Column, least: float = 1.0, most: float = 200.0, log: bool = True) -> Column:
    """NULL unless over `least`; then clipped, and log1p if asked."""
    kept = F.when(finite(c) > least, F.least(c, F.lit(most)))
    return F.log1p(kept) if log else kept


def bucket_of(c: Column, edges=CF_EDGES) -> Column:
    """Edges passed; an edge itself belongs below."""
    return sum(((c > e).cast("int") for e in sorted(edges)), F.lit(0))


def split_of(key: Column, ratios=SPLIT_RATIOS) -> Column:
    """train, val or test from the key's MD5, so that reruns and other engines agree."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    u = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
    return F.when(u < ratios[0], "train").when(u < ratios[0] + ratios[1], "val").otherwise("test")


def source_key(*fields: str) -> Column:
    return F.concat_ws("|", *(F.col(f).cast("string") for f in fields))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_")


def to_int(c: Column) -> Column:
    return c.try_cast("bigint")


def number_list(c: Column) -> Column:
    """'0.2, 0.6' as an array; parts that are no numbers are NULL."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))


def split_label(c: Column) -> Column:
    """Codes 0, 1, 2 as names; missing as 'all'."""
    return F.coalesce(F.when(c == "0", "train").when(c == "1", "val").when(c == "2", "test").otherwise(c), F.lit("all"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column, least: float = 0.0, norms: tuple[Column, Column] | None = None) -> Column:
    """1 where a norm is at most `least`. norms: those of a and b, if they are known."""
    na, nb = norms or (F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))
    return F.when((na <= least) | (nb <= least), 1.0).otherwise(1 - F.try_divide(dot(a, b), na * nb))


def length(v: Column, floor: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(floor))


def unit(v: Column, floor: float = 1e-12, norm: Column | None = None) -> Column:
    """norm: the length of v, if it is known; else it is taken anew for each number."""
    return F.transform(v, lambda x: x / (length(v, floor) if norm is None else norm))


def masked_mean_square(a: Column, b: Column, least_common: int = 1) -> Column:
    """Mean squared difference over dimensions that neither vector misses; NULL below `least_common` of them (2 or more)."""
    common = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    total, n = F.aggregate(common, F.lit(0.0), lambda s, x: s + x), F.size(common)
    mean = total / F.greatest(n, F.lit(1))
    return F.when(n >= least_common, mean) if least_common > 1 else mean


def common_dims(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull()), lambda m: m))


def lower_median(name: str) -> Column:
    """Aggregate: the lower of the two middles of a column."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")
