"""The library's functions under names for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BYTES = "CASE WHEN octet_length({s}) = 0 THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, octet_length({s})), i -> cast(conv(substring(hex(encode({s}, 'UTF-8')), 2 * i - 1, 2), 16, 10) AS bigint)) END"
_FNV = "aggregate({data}, 2166136261L, (h, b) -> ((h ^ b) * 16777619L) & 4294967295L)"

FUNCTIONS = {
    "fnv1a32(s STRING) RETURNS BIGINT": _FNV.format(data=_BYTES.format(s="s")),
    "shard_for(venue INT, market INT, symbol STRING, shards INT) RETURNS BIGINT": _FNV.format(data="concat(array(cast(venue AS bigint), cast(market AS bigint)), " + _BYTES.format(s="symbol") + ")") + " % shards",
    "to_d8(mantissa BIGINT, scale INT) RETURNS BIGINT": "CASE WHEN scale <= 8 THEN mantissa * cast(pow(10, 8 - scale) AS bigint) ELSE mantissa div cast(pow(10, scale - 8) AS bigint) END",
    "bps_apart(a BIGINT, b BIGINT) RETURNS BIGINT": "CASE WHEN a = 0 THEN 0 ELSE (abs(a - b) * 10000) div a END",
    "client_order_id(instance BIGINT, counter BIGINT) RETURNS STRING": "format_string('cc-%04x-%016x', instance, counter)",
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session, as SQL expressions that Catalyst inlines."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
