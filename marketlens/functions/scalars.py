"""Scalar functions of market data as Spark columns: fixed-point numbers, hashes, identifiers, names. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
# FNV-1a offset bases and primes, 32 and 64 bits
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
FNV64_BASIS_HI, FNV64_BASIS_LO, FNV64_PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
VENUE_FIRST, MARKET_SPOT, MARKET_FUTURES = 1, 1, 2
SHADOW_STREAMS = 1000


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def pow10(scale) -> Column:
    """10 ** scale as a long; scale is a number or a column of 0 to 18."""
    return F.element_at(F.array(*[_long(10**i) for i in range(19)]), F.lit(scale).cast("int") + 1 if not isinstance(scale, Column) else scale.cast("int") + 1)


def div(a: Column, b: Column) -> Column:
    """Integer division cut towards zero, within decimals, so that large values stay exact."""
    wide = "decimal(20,0)"
    return ((a - a % b).cast(wide) / b.cast(wide)).cast("long")


def parse_scaled(text: Column, scale: int | Column, empty_integer_is_zero: bool = True) -> Column:
    """Decimal text as an integer of 10 ** -scale, further digits cut off; the sign holds for the fraction too. Null for what is no
    number. The scale, 0 to 18, is a number or a column."""
    places = scale if isinstance(scale, Column) else F.lit(scale)
    trimmed = F.trim(text)
    negative = trimmed.startswith("-")
    body = F.regexp_replace(trimmed, "^[-+]", "")
    point = F.instr(body, ".")
    whole = F.when(point > 0, F.substring_index(body, ".", 1)).otherwise(body)
    fraction = F.when(point > 0, F.substr(body, point + 1)).otherwise("")
    digits = F.concat(F.lit("0"), F.rpad(F.substr(fraction, F.lit(1), places.cast("int")), places.cast("int"), F.lit("0")))
    ok = whole.rlike("^[0-9]*$") & fraction.rlike("^[0-9]*$")
    ok = ok if empty_integer_is_zero else ok & (whole != "")
    value = F.when(whole == "", _long(0)).otherwise(whole.try_cast("long")) * pow10(places) + digits.try_cast("long")
    return F.when(ok, F.when(negative, -value).otherwise(value))


def parse_scaled_by(text: Column, factor: Column) -> Column:
    """Decimal text times a power of ten, further digits cut off, with white space around it ignored. Null for what is no number, empty
    text among it."""
    scale = F.round(F.log10(factor)).cast("int")
    return F.when(F.trim(text) != "", parse_scaled(text, scale))


def derive_scale(text: Column) -> Column:
    """Number of characters after the point, trailing zeros too; 0 without a point."""
    return F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)


def rescale(mantissa: Column, scale, to: int = 8) -> Column:
    """A mantissa of ``scale`` decimals with ``to`` decimals; division cuts towards zero."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    up = mantissa * pow10(F.greatest(F.lit(to) - scale, F.lit(0)))
    return F.when(scale <= to, up).otherwise(div(mantissa, pow10(F.greatest(scale - to, F.lit(0)))))


def as_decimal(mantissa: Column, scale, to: int = 8, precision: int = 18) -> Column:
    """The value as DECIMAL(precision, to)."""
    return (rescale(mantissa, scale, to).cast(f"decimal({precision + to},0)") / F.lit(10**to).cast(f"decimal({to + 1},0)")).cast(f"decimal({precision},{to})")


def ms_to_ns(ms: Column) -> Column:
    return F.try_multiply(ms, _long(1_000_000))


def us_to_ns(us: Column) -> Column:
    return F.try_multiply(us, _long(1_000))


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as longs."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def fnv32(data: Column) -> Column:
    """FNV-1a of an array of byte values, 32 bits."""
    return F.aggregate(data, _long(FNV32_BASIS), lambda h, b: (h.bitwiseXOR(b) * _long(FNV32_PRIME)).bitwiseAND(_long(_MASK)))


def instrument_id(symbol: Column) -> Column:
    return fnv32(_bytes(symbol))


def shard_of(symbol: Column, shards: int, venue: int = VENUE_FIRST, market: int = MARKET_SPOT) -> Column:
    """Which of ``shards`` a symbol of a venue and market belongs to."""
    return fnv32(F.concat(F.array(_long(venue), _long(market)), _bytes(symbol))) % shards


def stream_of(shard: Column, shadow: bool = False) -> Column:
    return shard + 1 + (SHADOW_STREAMS if shadow else 0)


def owner_of(shard: Column, instances: int) -> Column:
    return shard % instances


def _le_bytes(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x.cast("long"), 8 * i).bitwiseAND(_long(255)) for i in range(8)]


def book_checksum(last_update_id: Column, bids: Column, asks: Column) -> Column:
    """FNV-1a of 64 bits over the id, bids from the highest and asks from the lowest price, as 16 hex digits.

    Sides are arrays of (price, qty); the product is kept in two limbs of 32 bits, so nothing overflows.
    """
    levels = F.concat(F.sort_array(bids, asc=False), F.sort_array(asks))
    data = F.concat(F.array(*_le_bytes(last_update_id)), F.flatten(F.transform(levels, lambda x: F.array(*_le_bytes(x["price"]), *_le_bytes(x["qty"])))))
    start = F.struct(_long(FNV64_BASIS_HI).alias("hi"), _long(FNV64_BASIS_LO).alias("lo"))

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        product = low * FNV64_PRIME_LOW
        high = h["hi"] * FNV64_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(_long(_MASK)).alias("hi"), product.bitwiseAND(_long(_MASK)).alias("lo"))

    return F.aggregate(data, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def aggressor_side(is_buyer_maker: Column) -> Column:
    """2 (sell) where the buyer is the maker, else 1 (buy)."""
    return F.when(is_buyer_maker, 2).otherwise(1)


def order_id(instance: Column, counter: Column) -> Column:
    """Client order id ``cc-<instance, 4 hex>-<counter, 16 hex>``."""
    return F.format_string("cc-%04x-%016x", instance.cast("long"), counter.cast("long"))


_ORDER_ID = "^cc-([0-9a-fA-F]+)-([0-9a-fA-F]+)$"


def order_instance(cloid: Column) -> Column:
    return F.conv(F.nullif(F.regexp_extract(cloid, _ORDER_ID, 1), F.lit("")), 16, 10).cast("long")


def order_counter(cloid: Column) -> Column:
    return F.conv(F.nullif(F.regexp_extract(cloid, _ORDER_ID, 2), F.lit("")), 16, 10).cast("long")


def bps(a: Column, b: Column) -> Column:
    """|a - b| in basis points of a, cut to an integer; 0 where a is 0."""
    top = F.abs(a - b) * 10_000
    return F.when(a == 0, _long(0)).otherwise(div(top, F.nullif(a, _long(0))))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / F.nullif(whole, _long(0)))


def backoff_ms(attempt: Column, base_ms: int = 1_000, cap_ms: int = 30_000) -> Column:
    """base * 2 ** min(attempt - 1, 6), at most the cap."""
    return F.least(_long(base_ms) * pow2(F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6))), _long(cap_ms))


def pow2(n: Column) -> Column:
    return F.element_at(F.array(*[_long(1 << i) for i in range(32)]), n.cast("int") + 1)


def stream_name(symbol: Column, kind: str) -> Column:
    """Subscription name, such as ``btcusdt@bookTicker``."""
    return F.concat(F.lower(symbol), F.lit(f"@{kind}"))


def latency(later: Column, earlier: Column) -> Column:
    """Difference of two times in ns; null where either is absent (0)."""
    return F.when((later != 0) & (earlier != 0), later - earlier)


def human_ns(ns: Column) -> Column:
    """A duration with its unit, for reports."""
    return (
        F.when(ns < 1_000, F.format_string("%d ns", ns))
        .when(ns < 1_000_000, F.format_string("%.1f us", ns / 1e3))
        .when(ns < 1_000_000_000, F.format_string("%.2f ms", ns / 1e6))
        .otherwise(F.format_string("%.3f s", ns / 1e9))
    )


def levels(pairs: Column, price_scale: int | Column, qty_scale: int | Column) -> Column:
    """[[price, qty], ...] of decimal texts as an array of scaled (price, qty)."""
    return F.transform(pairs, lambda p: F.struct(parse_scaled(F.element_at(p, 1), price_scale).alias("price"), parse_scaled(F.element_at(p, 2), qty_scale).alias("qty")))
