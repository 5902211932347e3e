"""Market views over the provided tables, in SQL that Spark and DuckDB share; only a few functions differ by dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: US(x): microseconds of a timestamp; JK(x): the integer at ``k`` of a JSON text.
_SPARK = {r"US\((\w+)\)": r"unix_micros(cast(\1 as timestamp))", r"JK\((\w+)\)": r"cast(get_json_object(\1, '$.k') as bigint)"}
_DUCKDB = {r"US\((\w+)\)": r"epoch_us(\1)", r"JK\((\w+)\)": r"cast(json_extract_string(\1, '$.k') as bigint)"}

VIEWS = {
    "instruments": """
        SELECT concat('P', p_partkey) AS symbol, p_brand AS base_asset, p_type AS quote_asset, 2 AS price_scale, 2 AS qty_scale, cast(1 as bigint) AS tick_size,
               cast(round(p_retailprice * 100) as bigint) AS min_notional, p_size, p_size > 5 AS is_trading, p_partkey FROM part""",
    "trades": """
        SELECT concat('P', l_partkey) AS symbol, l_orderkey, l_orderkey * 8 + l_linenumber AS trade_id, cast(round(l_extendedprice * 100) as bigint) AS price,
               cast(round(l_quantity * 100) as bigint) AS qty, 2 AS price_scale, 2 AS qty_scale, US(l_shipdate) * 1000 AS trade_ts, US(o_orderdate) * 1000 AS exchange_event_ts,
               l_returnflag = 'R' AS is_buyer_maker FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ticks": """
        SELECT event_id, user_id, concat('U', user_id) AS symbol, event_type, cast(round(value * 100) as bigint) AS price, JK(props) AS k, US(ts) * 1000 AS ts_ns FROM events""",
    "bbo": """
        SELECT symbol, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS instance_id, event_id AS update_id, ts_ns, 2 AS price_scale, 0 AS qty_scale, price AS bid_price, k + 1 AS bid_qty,
               price + 1 + k AS ask_price, k + 2 AS ask_qty FROM ticks WHERE event_type IN ('view', 'click')""",
    "marks": """
        SELECT symbol, ts_ns, event_id, price AS mark, k FROM ticks WHERE event_type = 'signup'""",
    "liquidations": """
        SELECT symbol, ts_ns, event_id, CASE WHEN k % 2 = 0 THEN 'BUY' WHEN k % 7 = 1 THEN 'NONE' ELSE 'SELL' END AS side_text, price, k + 1 AS qty FROM ticks WHERE event_type = 'error'""",
    "numbered": """
        SELECT *, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) as bigint) AS n FROM ticks""",
    "deltas": """
        SELECT symbol, event_id, ts_ns, n, k, CASE WHEN n = 1 OR k % 25 = 3 THEN 'snapshot' ELSE 'delta' END AS kind,
               10 * (n - 1) + 1 - CASE WHEN k = 11 THEN 5 ELSE 0 END AS first_id, 10 * n AS final_id, 10 * (n - 1) - CASE WHEN k = 11 THEN 5 ELSE 0 END AS prev_id,
               price, k % 10 AS qty, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side FROM numbered WHERE n = 1 OR k % 33 <> 7""",
    "book": """
        SELECT symbol, n, kind, side, CASE WHEN side = 'B' THEN price % 500 ELSE 500 + price % 500 END AS price, qty FROM deltas""",
    "latencies": """
        SELECT event_id, event_type, ts_ns, (k - 3) * (k + 1) * (event_id % 977) * 137 AS latency_ns FROM ticks""",
    "requests": """
        SELECT o_orderkey AS order_id, o_custkey % 16 AS instance, o_orderkey AS counter, o_orderstatus AS status, cast(round(o_totalprice * 100) as bigint) AS value, US(o_orderdate) * 1000 AS ts_ns FROM orders""",
    "fills": """
        SELECT l_orderkey AS order_id, l_orderkey * 8 + l_linenumber AS trade_id, cast(round(l_extendedprice * 100) as bigint) AS price, cast(round(l_quantity * 100) as bigint) AS qty,
               US(l_shipdate) * 1000 AS ts_ns, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as bigint) AS ord
        FROM lineitem""",
    "definitions": """
        SELECT symbol, v AS version, base_asset, quote_asset, price_scale, qty_scale, tick_size + CASE WHEN v = 1 AND p_partkey % 5 = 0 THEN 1 WHEN v = 2 AND p_partkey % 5 = 0 THEN 1 ELSE 0 END AS tick_size, min_notional,
               CASE WHEN v = 2 AND p_partkey % 7 = 0 THEN NOT is_trading ELSE is_trading END AS is_trading
        FROM instruments CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) AS versions""",
    "attempts": """
        SELECT symbol, event_id, ts_ns, k % 10 = 0 AS ok FROM ticks""",
    "offers": """
        SELECT symbol, event_id, event_id * 60000 + k * 1000 AS ts_ns, CASE WHEN k < 25 THEN 'Ok' WHEN k = 99 THEN 'Closed' WHEN k % 9 = 0 THEN 'AdminAction' ELSE 'BackPressured' END AS offer FROM ticks""",
    "checksums": """
        SELECT symbol, event_id, n, n AS ord, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS instance_id, (n + 1) // 2 - CASE WHEN k % 31 = 5 THEN 8 ELSE 0 END AS update_id,
               CASE WHEN k % 13 = 0 THEN 'x' ELSE 'y' END AS checksum FROM numbered""",
    "arrivals": """
        SELECT event_id, symbol, event_type, ts_ns, ts_ns + (event_id * 7919 % 97) * (event_id * 104729 % 89) * 4000000000 AS arrived_ns FROM ticks""",
    "refreshes": """
        SELECT symbol, version, US(started) * 1000 + (version * 500 + length(symbol) * 40 + CASE WHEN version = 1 THEN tick_size ELSE 0 END) * 86400000000000 AS refreshed_ns, tick_size, is_trading, base_asset
        FROM definitions CROSS JOIN (SELECT cast('1993-01-01' as timestamp) AS started) AS epoch""",
    "lifecycles": """
        SELECT order_id, ts_ns, 'submit' AS event FROM requests
        UNION ALL SELECT order_id, ts_ns + order_id % 10 * 86400000000000, 'ack' FROM requests WHERE order_id % 11 <> 0
        UNION ALL SELECT order_id, ts_ns + 3 * 86400000000000, 'reject' FROM requests WHERE order_id % 13 = 0
        UNION ALL SELECT order_id, ts_ns + 9 * 86400000000000, 'cancel' FROM requests WHERE order_id % 4 = 0""",
    "feed_checksums": """
        SELECT concat('G', user_id % 5) AS symbol, n AS ord, event_id, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS instance_id,
               (n + 1) // 2 - CASE WHEN k % 31 = 5 THEN 70 WHEN k % 17 = 3 THEN 20 ELSE 0 END AS update_id, CASE WHEN k % 13 = 0 THEN 'x' ELSE 'y' END AS checksum
        FROM (SELECT user_id, event_id, k, cast(row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts_ns, event_id) as bigint) AS n FROM ticks) AS grouped""",
    "accounts": """
        SELECT c_custkey, c_name, concat(cast(c_acctbal as decimal(15, 2)), '') AS balance FROM customer""",
}


def _expand(name: str, seen: list[str]) -> list[str]:
    """The views that a view reads, itself last."""
    for other in VIEWS:
        if other != name and other not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", VIEWS[name]):
            _expand(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _in(dialect: dict[str, str], text: str) -> str:
    for pattern, to in dialect.items():
        text = re.sub(pattern, to, text)
    return text


#: Rows of a task, where there are more of them than Spark's number of shuffle partitions would take
TASK_ROWS = 500_000

#: Views with a window over all rows of a table: the table, and the key by which its rows are dealt to tasks
_DEALT = {"fills": ("lineitem", "l_orderkey"), "numbered": ("events", "user_id")}


def tasks(spark: SparkSession, sf_dir: str, *tables: str, times: int = 1) -> int:
    """Tasks for so many ``times`` the rows of these tables: Spark's number of shuffle partitions, or more, so that none takes more than
    about TASK_ROWS. Counting Parquet rows reads no column."""
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * times // TASK_ROWS))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A market view as a DataFrame over the tables below ``sf_dir``."""
    names = _expand(name, [])
    text = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + f"\nSELECT * FROM {name}"
    text = _in(_SPARK, text).replace("//", "div")
    used = [t for t in _TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text) and t not in names]
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", text) if used else text
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for table, key in (_DEALT[n] for n in names if n in _DEALT):
        n = tasks(spark, sf_dir, table)
        if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
            read[table] = read[table].repartition(n, key)
    return spark.sql(text, **read)


class Views:
    """The views over the tables below a folder, by name, and how many tasks their rows are for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(*self._at, name)

    def tasks(self, *tables: str, times: int = 1) -> int:
        return tasks(*self._at, *tables, times=times)


def duckdb(body: str) -> str:
    """DuckDB SQL: the views that ``body`` reads as common tables before it. A body may begin with its own ``WITH``."""
    names: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body, re.I):
            _expand(name, names)
    body = body.strip()
    recursive = bool(re.match(r"WITH RECURSIVE\b", body, re.I))
    rest = re.sub(r"^WITH( RECURSIVE)?\b", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not names:
        return _in(_DUCKDB, body)
    return _in(_DUCKDB, head + views + ("," + rest if rest is not None else "\n" + body))
