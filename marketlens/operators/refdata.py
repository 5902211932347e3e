"""Instrument definitions: changes, latest versions, broadcast to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("base_asset", "quote_asset", "price_scale", "qty_scale", "tick_size", "step_size", "min_qty", "min_notional", "contract_size", "is_trading")


def changes(definitions: DataFrame, order: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Added and Updated definitions in order, and whether a trading status goes with them: when new, or when trading flipped."""
    fields = tuple(f for f in fields if f in definitions.columns)
    by = Window.partitionBy("symbol").orderBy(order)
    body = F.struct(*fields)
    marked = definitions.withColumn("_before", F.lag(body).over(by)).withColumn("_first", F.row_number().over(by) == 1)
    change = F.when(F.col("_first"), "Added").when(~body.eqNullSafe(F.col("_before")), "Updated")
    flipped = F.col("_first") | ~F.col("is_trading").eqNullSafe(F.col("_before.is_trading"))
    return marked.withColumn("change", change).withColumn("status_event", flipped).where(F.col("change").isNotNull()).drop("_before", "_first")


def latest(definitions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; one aggregate, combined before the shuffle."""
    rest = [c for c in definitions.columns if c not in keys]
    best = definitions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def to_shards(definitions: DataFrame, shards: int) -> DataFrame:
    """Every definition for every shard's stream, followed by its trading status."""
    kinds = F.array(F.struct(F.lit(0).alias("ord"), F.lit("InstrumentDefinition").alias("message")), F.struct(F.lit(1).alias("ord"), F.lit("TradingStatus").alias("message")))
    spread = definitions.withColumn("shard_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_kind", F.explode(kinds))
    return spread.withColumn("ord", F.col("_kind.ord")).withColumn("message", F.col("_kind.message")).drop("_kind")


def valid_at(events: DataFrame, versions: DataFrame, time: str, since: str, values: list[str], width: int) -> DataFrame:
    """Events with the ``values`` of their symbol's version that is valid at their time; null before the first one.

    A version is valid from its ``since`` until the next one's; of several with one ``since`` the one with the largest values is. Time is
    cut into slices of ``width``, so a symbol with very many events is spread over its times: each slice that has events is given the
    version valid at its start, and an event takes the last version before it in its slice. Work follows the events and versions, however
    long those are valid, and no side is broadcast. A version that is the same as the one before should not be given (see ``changes``).
    """
    def start(at):
        return F.col(at) - F.pmod(F.col(at), F.lit(width))

    given = versions.where(F.col("symbol").isNotNull() & F.col(since).isNotNull())
    once = given.groupBy("symbol", F.col(since).alias("_at")).agg(F.max(F.struct(*values)).alias("_v"))
    slices = events.select("symbol", start(time).alias("_at")).where(F.col("symbol").isNotNull() & F.col("_at").isNotNull()).distinct()
    valid = F.last("_v", ignorenulls=True)
    met = slices.unionByName(once, allowMissingColumns=True)
    known = met.withColumn("_known", valid.over(Window.partitionBy("symbol").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    known = known.where(F.col("_v").isNull() & F.col("_known").isNotNull()).select("symbol", "_at", F.col("_known").alias("_v"))
    rows = known.withColumn("_kind", F.lit(0)).unionByName(once.withColumn("_kind", F.lit(1)))
    rows = events.withColumn("_at", F.col(time)).withColumn("_kind", F.lit(2)).unionByName(rows, allowMissingColumns=True).withColumn("_slice", start("_at"))
    by = Window.partitionBy("symbol", "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_v", valid.over(by)).where("_kind = 2").select(*events.columns, *[F.col(f"_v.{c}").alias(c) for c in values])
