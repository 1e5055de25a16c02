"""Column helpers used inside the operators. All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
HOUR = 3600
EPS = 1e-6
DEFAULT_VENUE = "polymarket"

# Horizon buckets in days, left-closed.
HORIZON_EDGES = (("lt7d", 0.0, 7.0), ("7to30d", 7.0, 30.0), ("30to90d", 30.0, 90.0), ("gt90d", 90.0, 10_000.0))


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(x, lo: float, hi: float) -> Column:
    """Both bounds inclusive; null stays null (greatest/least would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def logit(p) -> Column:
    p = clip(p, EPS, 1 - EPS)
    return F.log(p / (1 - p))


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def brier(p, y) -> Column:
    d = col(p) - col(y)
    return d * d


def log_loss(p, y) -> Column:
    p, y = clip(p, EPS, 1 - EPS), col(y)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def skill(p_model, p_market, y) -> Column:
    """Market Brier minus model Brier: positive when the model beats the price."""
    return brier(p_market, y) - brier(p_model, y)


def cluster_key(event_id="event_id", condition_id="condition_id") -> Column:
    return F.coalesce(F.nullif(col(event_id), F.lit("")), col(condition_id))


def venue_of(venue="venue") -> Column:
    return F.coalesce(col(venue), F.lit(DEFAULT_VENUE))


def day_of(ts_s) -> Column:
    """UTC calendar day as days since the epoch."""
    return F.floor(col(ts_s) / F.lit(DAY)).cast("long")


def horizon_bucket(days) -> Column:
    days = col(days)
    out = F.when(days.isNull() | (days <= 0), F.lit(None).cast("string"))
    for name, lo, hi in HORIZON_EDGES:
        inside = days >= lo if hi is None else (days >= lo) & (days < hi)
        out = out.when(inside, F.lit(name))
    return out


def greatest_strict(a, b) -> Column:
    """Null when either side is null, unlike F.greatest."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def hash_int(text) -> Column:
    """First 8 hex digits of sha256 as an integer; the seeded draw of every sampler."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 8), 16, 10).cast("long")


def hash_uniform(text) -> Column:
    return hash_int(text) / F.lit(4294967296.0)


def effective_n(n, rho) -> Column:
    rho = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(col(rho), F.lit(0.0))))
    return col(n) / (1 + (col(n) - 1) * rho)


def discounted_exponent(a, n, rho) -> Column:
    n = col(n)
    return F.when(n <= 1, F.lit(1.0)).otherwise(1 + (col(a) - 1) * (effective_n(n, rho) - 1) / (n - 1))


def bounded(new, old, max_step: float = 0.2) -> Column:
    """Move at most max_step of the old value; a missing or zero old value passes."""
    new, old = col(new), col(old)
    step = F.abs(old) * max_step
    return F.when(old.isNull() | (old == 0), new).otherwise(F.least(old + step, F.greatest(old - step, new)))


def sufficiency(n) -> Column:
    n = col(n)
    return (F.when(n < 200, F.lit("INSUFFICIENT DATA"))
            .when(n < 500, F.lit("PRELIMINARY")).otherwise(F.lit("STANDARD")))


def first_number(text) -> Column:
    """First number of a text; dollar signs and thousands commas dropped."""
    raw = F.regexp_extract(col(text), r"-?\$?\d[\d,]*\.?\d*", 0)
    cleaned = F.regexp_replace(F.regexp_replace(raw, r"^\$+", ""), ",", "")
    return cleaned.try_cast("double")


def normal_cdf(z) -> Column:
    """Abramowitz-Stegun 7.1.26 polynomial; absolute error below 2e-7."""
    z = col(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def canonical_row(cols: list[str]) -> Column:
    """Sorted-key compact JSON with nulls kept: the one text every digest reads."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


# Fixed value: the timestamp spellings venues use.
VENUE_TS = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(?:\.\d+)?\s*(Z|[+-]\d{2}(?::?\d{2})?(?::\d{2})?)?$"


def venue_ts(text) -> Column:
    """Mixed spellings to epoch seconds, UTC; any other offset or shape gives null."""
    t = F.trim(col(text))
    stamp = F.concat_ws(" ", F.regexp_extract(t, VENUE_TS, 1), F.regexp_extract(t, VENUE_TS, 2))
    offset = F.regexp_extract(t, VENUE_TS, 3)
    utc = offset.isin("", "Z") | offset.rlike("^[+-][0:]+$")
    return F.when(t.rlike(VENUE_TS) & utc, F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))))


def epoch_any(text) -> Column:
    """Seconds, milliseconds or ISO text to epoch seconds, told apart by magnitude."""
    text = col(text).cast("string")
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > 1e12, F.floor(number / 1000)).when(F.abs(number) > 1e9, F.floor(number))
    iso = F.coalesce(venue_ts(text), F.unix_seconds(F.try_to_timestamp(text)))
    return F.when(number.isNotNull() & (F.abs(number) > 1e9), seconds.cast("long")).otherwise(iso)


def clamp_p(p) -> Column:
    """A model's final probability stays within the fixed bounds."""
    return clip(p, 0.01, 0.99)
