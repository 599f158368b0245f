"""Fixed-point prices and quantities as Column helpers: one helper for each rounding rule, never a bare cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY_SCALE = 1_000_000.0
_LOW, _HIGH = -(2**63), 2**63 - 1


def check_tick_size(tick_size: float) -> float:
    if not tick_size > 0:
        raise ValueError(f"tick_size must be positive, not {tick_size}")
    return float(tick_size)


def to_long(x: Column) -> Column:
    """Truncates a double to a long; beyond the range the nearest bound, NaN is 0."""
    return F.when(F.isnan(x), F.lit(0)).when(x >= float(2**63), F.lit(_HIGH)).when(x < float(_LOW), F.lit(_LOW)).otherwise(x.try_cast("long"))


def price_half_even(price: Column, tick_size: Column | float) -> Column:
    """Feed rule: ties go to the even tick."""
    return F.bround(price / _lit(tick_size)).cast("long")


def price_half_away(price: Column, tick_size: Column | float) -> Column:
    """Order and candle rule: ties go away from zero."""
    return to_long(F.round(price / _lit(tick_size)))


def price_truncate(price: Column, tick_size: Column | float) -> Column:
    """Batch rule: toward zero."""
    return to_long(price / _lit(tick_size))


def scale_qty(qty: Column) -> Column:
    """Order and tick quantities in millionths, truncated; some six-digit decimals lose one unit, as in the kernel."""
    return to_long(qty * QTY_SCALE)


def scale_volume(volume: Column) -> Column:
    """Candle volumes in millionths, rounded half away from zero."""
    return to_long(F.round(volume * QTY_SCALE))


def descale(scaled: Column) -> Column:
    return scaled / F.lit(QTY_SCALE)


def bucket_start(ts: Column, width: int) -> Column:
    """Floor of ts to a multiple of width, below zero too."""
    if width <= 0:
        raise ValueError(f"bucket width must be positive, not {width}")
    return ts - F.pmod(ts, F.lit(width))


def side_of_maker(is_buyer_maker: Column) -> Column:
    """SELL where the buyer was the maker, BUY where not; null stays null."""
    return F.when(is_buyer_maker, "SELL").when(~is_buyer_maker, "BUY")


def side_code(is_buyer_maker: Column) -> Column:
    """0 for BUY, 1 for SELL."""
    return is_buyer_maker.cast("byte")


def parsed_tag(tag: Column, allowed: tuple[str, ...], what: str) -> Column:
    """Upper-cases a side or order type; any other value fails the query."""
    up = F.upper(tag)
    return F.when(up.isin(*allowed), up).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(tag, F.lit("null")))))


def side_from_code(code: Column) -> Column:
    """BUY for 0, SELL for 1; any other value fails the query before a row is applied."""
    return F.when(code == 0, "BUY").when(code == 1, "SELL").otherwise(F.raise_error(F.concat(F.lit("invalid side: "), F.coalesce(code.cast("string"), F.lit("null")))))


def side_number(side: Column) -> Column:
    """0 for BUY, 1 for SELL, of a tag in any case; any other value fails the query."""
    return F.when(parsed_tag(side, ("BUY", "SELL"), "side") == "SELL", 1).otherwise(0)


def order_type_number(kind: Column) -> Column:
    """0 for LIMIT, 1 for MARKET, of a tag in any case; any other value fails the query."""
    return F.when(parsed_tag(kind, ("LIMIT", "MARKET"), "order type") == "MARKET", 1).otherwise(0)


def ms_to_timestamp(ms: Column) -> Column:
    """Milliseconds to a timestamp, which is shown in the time zone of the session."""
    return F.timestamp_millis(ms)


#: Bounds of the steps; fixed values.
NICE = ((1.5, 1.0), (3.0, 2.0), (3.5, 2.5), (7.0, 5.0))


def nice_step(value: Column) -> Column:
    """The step of 1, 2, 2.5, 5 or 10 times a power of ten that the value is close to; null for values that are not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    n = value / power
    step = F.lit(10.0)
    for bound, size in reversed(NICE):
        step = F.when(n <= bound, size).otherwise(step)
    return F.when(value > 0, step * power)


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
