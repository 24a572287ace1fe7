"""Column functions that keep the statistical-script meaning of NA and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAYS_PER_MONTH = 30.44
NEAR_TOLERANCE = 1.4901161193847656e-8
MONTH_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM-yy", "MMM yyyy", "MM/yyyy", "yyyy-MM")
AVG_Z = 1.96


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long_array(values) -> Column:
    """Constant array of whole numbers, parsed once rather than built call by call."""
    return F.expr("array(" + ", ".join("cast(null as bigint)" if v is None else f"{int(v)}L" for v in values) + ")")


def struct_array(rows, names) -> Column:
    """Constant array of structs of whole numbers."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {int(v)}L" for n, v in zip(names, r)) + ")" for r in rows) + ")")


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparable results."""
    return F.round(col(c), digits) + F.lit(0.0)


def sum0(c) -> Column:
    """Sum that is 0 for a group holding only nulls."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def count_distinct_na(c) -> Column:
    """Distinct count in which null is one more value."""
    c = col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))


def near(a, b) -> Column:
    return F.abs(col(a) - col(b)) < F.lit(NEAR_TOLERANCE)


def rate_per_1000(num, den) -> Column:
    return F.when(col(den) > 0, F.lit(1000.0) * col(num) / col(den))


def log_outcome(x, eps: float | None = None) -> Column:
    """``log1p`` of a clipped count, or a log of a clipped rate plus ``eps``."""
    clipped = F.greatest(col(x).cast("double"), F.lit(0.0))
    return F.log1p(clipped) if eps is None else F.ln(clipped + F.lit(eps))


def month_index(d) -> Column:
    d = col(d)
    return (F.year(d) * 12 + F.month(d)).cast("bigint")


def months_real(later, earlier) -> Column:
    return F.datediff(col(later), col(earlier)) / F.lit(DAYS_PER_MONTH)


def months_whole(later, earlier) -> Column:
    """Completed calendar months between two dates.

    ``months_between`` treats two month ends as whole months apart; completed
    months follow the day of month instead."""
    later, earlier = col(later), col(earlier)
    diff = month_index(later) - month_index(earlier)
    short = (diff > 0) & (F.dayofmonth(later) < F.dayofmonth(earlier))
    long_ = (diff < 0) & (F.dayofmonth(later) > F.dayofmonth(earlier))
    return diff - short.cast("bigint") + long_.cast("bigint")


def parse_month(s) -> Column:
    """First day of the month named by text in any accepted layout."""
    s = F.trim(col(s))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in MONTH_FORMATS])
    month = F.trunc(parsed.cast("date"), "MM")
    # Two-digit years from 69 on belong to the twentieth century.
    return F.when(F.year(month) >= 2069, F.add_months(month, -1200)).otherwise(month)


def letters_key(s) -> Column:
    """Join key of a place name: lower case letters only."""
    return F.regexp_replace(F.lower(F.trim(col(s))), "[^a-z]", "")


def trailing_code(s) -> Column:
    """Two-letter code after the last comma, or null."""
    found = F.regexp_extract(col(s), r"(?<=,\s)[A-Z]{2}$", 0)
    return F.nullif(found, F.lit(""))


def fips5(state, county) -> Column:
    return F.concat(F.lpad(col(state).cast("string"), 2, "0"), F.lpad(col(county).cast("string"), 3, "0"))


def in_window(d, start, end, closed: str = "both") -> Column:
    d = col(d)
    upper = d <= F.lit(end) if closed == "both" else d < F.lit(end)
    return (d >= F.lit(start)) & upper


def event_bin(e, lo: int, hi: int) -> Column:
    """Event-time label inside ``lo..hi``; never-treated and outside rows named."""
    e = col(e)
    return (
        F.when(e.isNull(), "Never treated")
        .when(e.between(lo, hi), e.cast("string"))
        .otherwise("Exclude")
    )


def linear(coefs, cols) -> Column:
    """Sum of coefficient times column."""
    out = F.lit(0.0)
    for b, c in zip(coefs, cols):
        out = out + F.lit(float(b)) * col(c)
    return out


def logistic(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


# Fixed values of the portable generator: a 31-bit mixer in plain integer
# arithmetic, so Spark, numpy and any SQL engine draw the same numbers.
MIX_MODULUS = 2147483648
MIX_KEY = 1103515245
MIX_STATE = 739982445
MIX_LAST = 695872825
MIX_ADD = 12345


def draw31(seed: int, *keys) -> Column:
    """Integer draw in [0, 2**31) from whole-number keys."""
    x = F.lit(seed).cast("bigint")
    for k in keys:
        key = F.pmod(col(k).cast("bigint"), F.lit(MIX_MODULUS))
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * MIX_STATE + MIX_ADD, F.lit(MIX_MODULUS))
        x = F.pmod(x + F.pmod(key * MIX_KEY, F.lit(MIX_MODULUS)), F.lit(MIX_MODULUS))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 13)) * MIX_LAST, F.lit(MIX_MODULUS))
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw31_numpy(seed: int, *keys):
    """The same draws for broadcastable integer arrays."""
    import numpy as np

    x = np.int64(seed)
    for k in keys:
        x = ((x ^ (x >> 15)) * MIX_STATE + MIX_ADD) % MIX_MODULUS
        x = (x + (np.asarray(k, dtype=np.int64) % MIX_MODULUS) * MIX_KEY % MIX_MODULUS) % MIX_MODULUS
    x = (x ^ (x >> 13)) * MIX_LAST % MIX_MODULUS
    return x ^ (x >> 16)


def draw31_sql(out: str, seed: int, *keys: str) -> str:
    """The same draws as a chain of select-list aliases ending in ``out``."""
    parts, x = [], f"({seed})::BIGINT"
    for i, k in enumerate(keys):
        parts.append(f"(xor({x}, {x} >> 15) * {MIX_STATE} + {MIX_ADD}) % {MIX_MODULUS} AS {out}_a{i}")
        parts.append(f"({out}_a{i} + (({k})::BIGINT % {MIX_MODULUS}) * {MIX_KEY} % {MIX_MODULUS}) % {MIX_MODULUS} AS {out}_b{i}")
        x = f"{out}_b{i}"
    parts.append(f"xor({x}, {x} >> 13) * {MIX_LAST} % {MIX_MODULUS} AS {out}_z")
    parts.append(f"xor({out}_z, {out}_z >> 16) AS {out}")
    return ", ".join(parts)


def uniform(seed: int, *keys) -> Column:
    """Uniform draw strictly between 0 and 1."""
    return (draw31(seed, *keys) + F.lit(0.5)) / F.lit(float(MIX_MODULUS))
