"""Scalar expressions. Each is a Column expression that stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY)


def finite_positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def percent_change(value: Column, base: Column) -> Column:
    """100 * (value / base - 1); null unless both are finite and positive."""
    return F.when(finite_positive(value) & finite_positive(base), F.lit(100.0) * (value / base - F.lit(1.0)))


def percent_move(value: Column, base: Column) -> Column:
    """((value - base) / base) * 100: the same number as ``percent_change``, rounded differently."""
    return F.when(finite(value) & finite_positive(base), (value - base) / base * F.lit(100.0))


def range_position(last: Column, low: Column, high: Column) -> Column:
    """Where ``last`` lies between low (0) and high (100); null for a range of no width or a value outside."""
    at = F.lit(100.0) * (last - low) / F.nullif(high - low, F.lit(0.0))
    return F.when((at >= 0) & (at <= 100), at)


def spread_cents(bid: Column, ask: Column) -> Column:
    return F.lit(100.0) * (ask - bid)


def spread_basis_points(bid: Column, ask: Column) -> Column:
    return F.lit(10000.0) * (ask - bid) / ((ask + bid) / F.lit(2.0))


def age_seconds(at: Column, observed: Column) -> Column:
    return F.greatest(at - observed, F.lit(0))


def floor_ratio(volume: Column, n: Column) -> Column:
    """floor(volume / n), corrected where the quotient of doubles was rounded to the wrong side."""
    q = F.floor(F.try_divide(volume.cast("double"), n.cast("double")))
    return F.when((q + 1) * n <= volume, q + 1).when(q * n > volume, q - 1).otherwise(q)


def is_plain_decimal(text: Column) -> Column:
    return text.rlike(r"^[0-9]+(\.[0-9]+)?$")


def exact_integer(number: Column) -> Column:
    """The bigint that a JSON number states exactly (1e3 and 5.0 do, 5.5 does not); null otherwise."""
    value = number.try_cast("decimal(38,9)")
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def unsigned_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def clamp_target(now_s: Column, start_s: Column, end_s: Column, delay_s: int) -> Column:
    """The evaluation time that a clock reading allows: delayed, in whole seconds, inside the session."""
    return F.least(F.greatest(F.floor(now_s - delay_s), start_s), end_s)


def backoff_seconds(attempt: Column, initial: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def quote_quality(classified: Column, conditions: Column, indicators: Column) -> Column:
    odd = F.exists(conditions, lambda x: x <= 0) | F.exists(indicators, lambda x: x <= 0)
    ordinary = (F.size(conditions) == 0) & (F.size(indicators) == 0)
    return F.when(~classified | odd, "unclassified").when(ordinary, "reviewed_ordinary").otherwise("known_special")


def ladder(value: Column, steps: list[tuple[float, float]], below: float) -> Column:
    """The result of the first step (descending bounds) that ``value`` reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for bound, result in steps[1:]:
        out = out.when(value >= bound, result)
    return out.otherwise(below)


# Display intensities by turnover and by float size.
TURNOVER_STEPS = [(5.0, 1.0), (2.0, 0.8), (1.0, 0.6), (0.5, 0.4), (0.25, 0.2)]
FLOAT_STEPS = [(50e6, 0.0), (20e6, 0.2), (10e6, 0.45), (5e6, 0.65), (2e6, 0.85)]


def turnover_intensity(volume: Column, shares: Column) -> Column:
    valid = finite(volume) & (volume >= 0) & finite_positive(shares)
    return F.when(valid, ladder(volume / shares, TURNOVER_STEPS, 0.0))


def float_intensity(shares: Column) -> Column:
    return F.when(finite_positive(shares), ladder(shares, FLOAT_STEPS, 1.0))


def signed_percent(ratio: Column) -> Column:
    return F.concat(F.when(ratio > 0, "+").otherwise(""), F.format_string("%.2f%%", ratio * 100))


def share_text(value: Column) -> Column:
    """1234567 as 1.2M; the next unit up where rounding reaches a thousand."""
    out = None
    for scale, suffix, carry in ((1e12, "T", None), (1e9, "B", "1T"), (1e6, "M", "1B"), (1e3, "K", "1M")):
        rounded = F.round(value / scale, 1)
        text = F.concat(F.regexp_replace(F.format_string("%.1f", rounded), r"\.0$", ""), F.lit(suffix))
        text = text if carry is None else F.when(rounded >= 1000, carry).otherwise(text)
        out = F.when(value >= scale, text) if out is None else out.when(value >= scale, text)
    return out.otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", ""))


def field(status: Column, reason: Column, value: Column) -> Column:
    """A measurement: its value is null unless it is current."""
    return F.struct(status.alias("status"), reason.alias("reason"), F.when(status == "current", value).alias("value"))


def checked_sum(a: Column, b: Column) -> Column:
    """a + b; null unless both and their sum are finite."""
    return F.when(finite(a) & finite(b) & finite(a + b), a + b)


def acknowledged_second(micros: Column, first_s: int, last_s: int) -> Column:
    """The whole second at or after a receipt (in microseconds), inside the session."""
    return F.least(F.greatest(F.ceil(micros / 1_000_000), F.lit(first_s)), F.lit(last_s))


def gradient(value: Column, stops: list[tuple[float, str]]) -> Column:
    """The colour of a value between the stops (position, #RRGGBB), each channel interpolated and rounded half up."""
    at = F.least(F.greatest(value.cast("double"), F.lit(float(stops[0][0]))), F.lit(float(stops[-1][0])))
    out = F.lit(stops[-1][1])
    for (low, start), (high, end) in reversed(list(zip(stops, stops[1:], strict=False))):
        part = (at - low) / (high - low) if high > low else F.lit(0.0)
        channels = [(int(start[k : k + 2], 16), int(end[k : k + 2], 16)) for k in (1, 3, 5)]
        mixed = [F.lpad(F.hex(F.floor(F.lit(a) + part * (b - a) + 0.5).cast("bigint")), 2, "0") for a, b in channels]
        out = F.when(at <= high, F.concat(F.lit("#"), *mixed)).otherwise(out)
    return F.when(finite(value.cast("double")), out)


def rfc3339(ts: Column) -> Column:
    """A timestamp as UTC text with no more digits of a second than it needs."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))
