"""Scalar column expressions (all JVM-side)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SERVICE_Z = {0.90: 1.28, 0.95: 1.65, 0.99: 2.33, 0.995: 2.58, 0.9995: 3.29}
SERVICE_Z_DEFAULT = 1.96
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}
WINTER_PEAK = [1.5, 1.4, 1.2, 0.9, 0.7, 0.6, 0.6, 0.7, 0.9, 1.1, 1.3, 1.5]
SUMMER_PEAK = [0.8, 0.9, 1.0, 1.2, 1.5, 1.6, 1.6, 1.5, 1.2, 1.0, 0.9, 0.8]
WINTER_CATEGORIES = ("Respiratory", "Antivirals")
SUMMER_CATEGORIES = ("Dermatology",)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_features(ts: Column) -> dict[str, Column]:
    """Calendar features of a timestamp; weekday counts from Monday = 0."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
    }


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def age_band(age: Column) -> Column:
    return (
        F.when(age < 18, "0-17").when(age < 35, "18-34").when(age < 50, "35-49").when(age < 65, "50-64").otherwise("65+")
    )


def age_category(age: Column) -> Column:
    return F.when(age < 18, 0).when(age < 35, 1).when(age < 50, 2).when(age < 65, 3).otherwise(4)


def currency(amount: Column, code: Column | str = "USD") -> Column:
    symbols = F.create_map(*[F.lit(x) for x in chain(*CURRENCY_SYMBOLS.items())])
    code = code if isinstance(code, Column) else F.lit(code)
    return F.concat(F.coalesce(symbols[code], F.lit("$")), F.format_string("%,.2f", amount))


def days_between(first: Column, second: Column) -> Column:
    """Absolute value of the floored signed day difference ``second - first``."""
    return F.abs(F.floor((micros(second) - micros(first)) / F.lit(86400e6)))


def tagged_id(prefix: str, *parts: Column) -> Column:
    """prefix + six digits + eight hex, both taken from a hash of the key."""
    digest = F.md5(F.concat_ws("|", *parts))
    digits = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint") % 1000000
    return F.concat(F.lit(prefix), F.lpad(digits.cast("string"), 6, "0"), F.substring(digest, 1, 8))


def millis_id(prefix: str, ts: Column) -> Column:
    """prefix + epoch milliseconds."""
    return F.concat(F.lit(prefix), F.floor(micros(ts) / 1000).cast("bigint").cast("string"))


def event_id(prefix: str, ts: Column, *parts: Column) -> Column:
    """prefix + epoch milliseconds + 64 bits of a hash, since milliseconds repeat."""
    return F.concat(millis_id(prefix, ts), F.lit("-"), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16))


def service_z(level: Column | float) -> Column:
    if not isinstance(level, Column):
        return F.lit(SERVICE_Z.get(level, SERVICE_Z_DEFAULT))
    table = F.create_map(*[F.lit(x) for x in chain(*SERVICE_Z.items())])
    return F.coalesce(table[level], F.lit(SERVICE_Z_DEFAULT))


def finite_or_zero(x: Column) -> Column:
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def at_least_zero(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def clip_int(x: Column, low: Column, high: Column) -> Column:
    """Truncate toward zero, then clip."""
    return F.greatest(low, F.least(high, x.cast("bigint").cast("double")))


def sine_season(base: Column, day: Column) -> Column:
    return F.lit(0.2) * base * F.sin(F.lit(2.0 * 3.141592653589793) * day / 7)


def seasonal_factor(category: Column, month: Column, winter=WINTER_CATEGORIES, summer=SUMMER_CATEGORIES) -> Column:
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), month)

    return (
        F.when(category.isin(*winter), pick(WINTER_PEAK)).when(category.isin(*summer), pick(SUMMER_PEAK)).otherwise(1.0)
    )


def hour_weight(hour: Column) -> Column:
    return F.when(hour.between(9, 20), 2.0).when((hour < 6) | (hour > 22), 0.3).otherwise(1.0)


def joined_reasons(*rules: tuple[Column, str], default: str) -> Column:
    text = F.concat_ws("; ", *[F.when(test, F.lit(label)) for test, label in rules])
    return F.when(text == "", default).otherwise(text)


def low_stock_text(name: Column, left: Column, kind: str = "remaining") -> Column:
    units = F.greatest(F.lit(0), left.cast("bigint")).cast("string")
    if kind == "remaining":
        return F.concat(name, F.lit(": "), units, F.lit(" units remaining"))
    if kind == "initial":
        return F.concat(name, F.lit(": Only "), units, F.lit(" units remaining"))
    return F.concat(name, F.lit(" below reorder point"))


def forecast_date(last_day: Column, ahead: Column) -> Column:
    """Calendar day of a zero-based day-ahead index."""
    return F.date_add(last_day, ahead.cast("int") + 1)
