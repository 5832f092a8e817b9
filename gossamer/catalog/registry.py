"""Query registry and the SQL side of the adapter tables."""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.sources.adapter import ALERT_SUPPORT, METRICS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ["joins", "filters", "aggregates", "graph", "places", "windows", "notable", "scalars", "feeds", "landed", "publish", "streams"]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name adapter tables, whose definitions are put in front."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return f"'{v}'" if isinstance(v, str) else repr(v)


_METRIC_COLS = ["metric", "topic", "label", "radius_km", "window_min", "tol_abs", "tol_rel", "lo", "hi", "direction",
                "accumulates", "is_flag", "scored", None, "headline", "headline_min"]
_METRIC_ROWS = ", ".join("(" + ", ".join(_lit(v) for v, c in zip(m, _METRIC_COLS) if c) + ")" for m in METRICS)
_THRESH_ROWS = ", ".join(f"('{m[0]}', {a!r}::DOUBLE, {s!r}::DOUBLE)" for m in METRICS for a, s in m[13])
_KIND = ("CASE user_id % 10 WHEN 0 THEN 'station' WHEN 1 THEN 'official' WHEN 2 THEN 'bot' "
         "WHEN 3 THEN 'authority' ELSE 'human' END")

# SQL text of each adapter table. A table may use earlier ones and the driver's views.
TABLES: dict[str, str] = {
    "signals": f"""SELECT event_id AS seq, user_id AS sensor_id, {_KIND} AS kind,
        CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'sales'
             WHEN 'signup' THEN 'sales' ELSE 'ops' END AS topic,
        event_type AS metric, value, ts AS observed_at, ts AS received_at, CAST(user_id % 25 AS VARCHAR) AS county_id,
        37.0::DOUBLE + ((user_id*37) % 550)/100.0::DOUBLE AS lat, -91.5::DOUBLE + ((user_id*53) % 450)/100.0::DOUBLE AS lon,
        CASE WHEN user_id % 3 = 0 THEN '24h' WHEN user_id % 3 = 1 THEN '1h' END AS period,
        CASE WHEN user_id % 4 = 0 THEN 'zip5' ELSE 'point' END AS "precision",
        CAST(60000 + user_id % 100 AS VARCHAR) AS zip5, 'feed' || (user_id % 4) AS source,
        (event_id // 4) || ':' || (event_id % 4) AS source_id, props FROM events""",
    "assessed": """SELECT *, CASE WHEN kind IN ('station','official','authority') THEN 'reference' WHEN value > 300 THEN 'rejected'
        WHEN seq % 11 = 0 THEN 'flagged' WHEN seq % 3 = 0 THEN 'corroborated' ELSE 'raw' END AS quality FROM signals""",
    "sensors": f"""SELECT user_id AS sensor_id, {_KIND} AS kind, CAST(user_id % 25 AS VARCHAR) AS county_id,
        37.0::DOUBLE + ((user_id*37) % 550)/100.0::DOUBLE AS lat, -91.5::DOUBLE + ((user_id*53) % 450)/100.0::DOUBLE AS lon,
        0.5::DOUBLE AS trust_prior, min(ts) AS registered_at,
        CASE WHEN user_id % 29 = 0 THEN 'banned' ELSE 'active' END AS status, user_id * 10 AS chat_id
        FROM events GROUP BY user_id""",
    "dim_county": """SELECT CAST(n_nationkey AS VARCHAR) AS county_id, n_nationkey::BIGINT AS ord, n_name AS name,
        CAST(n_regionkey AS VARCHAR) AS state_id, 37.25::DOUBLE + (n_nationkey % 5)*1.1::DOUBLE AS lat,
        -91.0::DOUBLE + (n_nationkey // 5)*0.9::DOUBLE AS lon FROM nation""",
    "county_edges": """SELECT county_id, ord, lat AS clat, lon AS clon, k,
        lon + [-0.5,-0.25,0.25,0.5,0.25,-0.25][k]::DOUBLE AS x1, lat + [0.0,0.6,0.6,0.0,-0.6,-0.6][k]::DOUBLE AS y1,
        lon + [-0.5,-0.25,0.25,0.5,0.25,-0.25][k % 6 + 1]::DOUBLE AS x2, lat + [0.0,0.6,0.6,0.0,-0.6,-0.6][k % 6 + 1]::DOUBLE AS y2
        FROM dim_county, range(1, 7) r(k)""",
    "dim_metric": f"SELECT * FROM (VALUES {_METRIC_ROWS}) v({', '.join(c for c in _METRIC_COLS if c)})",
    "dim_threshold": f"SELECT * FROM (VALUES {_THRESH_ROWS}) v(metric, lim, severity)",
    "dim_alert_support": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALERT_SUPPORT) + ") v(metric, slug)",
    "crossings": """SELECT s.*, m.direction, m.window_min, max(t.severity) AS severity FROM signals s JOIN dim_metric m USING (metric)
        JOIN dim_threshold t ON t.metric = s.metric AND CASE WHEN m.direction = 'below' THEN s.value <= t.lim ELSE s.value >= t.lim END
        GROUP BY ALL""",
    "alerts": """SELECT event_id AS alert_id, user_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOURS THEN lag(event_id) OVER w END AS ref_id,
        CAST(user_id % 25 AS VARCHAR) AS county_id, 1 + event_id % 4 AS severity, ts AS sent, ts + INTERVAL 6 HOURS AS expires,
        'error_alert' AS slug, 'office' || (user_id % 7) AS sender FROM events WHERE event_type = 'error'
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "alert_rows": """SELECT event_id AS alert_id, user_id, CAST(user_id % 25 AS VARCHAR) AS county_id, 1 + event_id % 4 AS severity,
        ts AS sent, ts + INTERVAL 6 HOURS AS expires, 'error_alert' AS slug, value, 'office' || (user_id % 7) AS sender,
        'g' || (event_id // 3) AS group_key, 'Kind ' || (event_id % 5) AS event FROM events WHERE event_type = 'error'""",
    "standing_alerts": """SELECT * REPLACE (CASE WHEN alert_id % 13 = 0 THEN NULL WHEN alert_id % 17 = 0 THEN expires + INTERVAL 40 DAYS ELSE expires END AS expires) FROM alert_rows""",
    "subscriptions": """SELECT c_custkey AS chat_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'warnings' WHEN 'BUILDING' THEN 'alerts'
        WHEN 'FURNITURE' THEN 'events' WHEN 'HOUSEHOLD' THEN 'reports' ELSE 'digest' END AS category,
        CASE WHEN c_custkey % 10 = 0 THEN 'st' WHEN c_custkey % 10 = 1 THEN 'st.zip.' || (60000 + c_custkey % 100)
             ELSE 'st.' || c_nationkey END AS area FROM customer""",
    "outbox": """SELECT o_orderkey AS id, ['alert:','event:','report:','digest:','confirm:','other:'][o_orderkey % 6 + 1] || o_orderkey
          || CASE WHEN o_orderkey % 12 = 0 THEN ':ask' ELSE '' END AS key,
        CASE WHEN o_orderkey % 6 = 0 THEN 'alert:' || o_orderkey END AS thread, o_custkey AS chat_id,
        CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'pending' ELSE 'dropped' END AS status,
        CASE o_orderkey % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'edit' ELSE 'send' END AS action, o_orderdate AS created_at,
        o_orderdate + to_seconds(o_orderkey % 300) AS sent_at, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS priority,
        o_orderdate + to_hours(o_orderkey % 3) AS next_attempt_at,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 2 HOURS END AS stale_at FROM orders""",
    "run_log": """SELECT event_id AS id, event_type AS source, ts AS run_at, CASE WHEN value >= 60 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN value >= 60 THEN 'HTTPError: ' || CAST(floor(value) AS BIGINT) END AS error, CAST(floor(value / 10) AS BIGINT) AS fetched
        FROM events""",
    "gauge_series": "SELECT user_id AS site, event_type AS metric, ts AS taken, value / 10.0::DOUBLE AS stage, event_id AS seq FROM events",
    "items": """SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, text AS content, source AS feed, lang AS topic, quality AS relevance,
        make_timestamp(1704067200000000 + doc_id * 3600000000) AS published_at FROM documents LEFT JOIN labels USING (doc_id)""",
    "doc_rows": """SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, text AS content, source AS feed, lang AS topic,
        make_timestamp(1704067200000000 + doc_id * 3600000000) AS published_at FROM documents""",
    "messages": "SELECT conv_id * 1000 + turn AS message_id, text FROM conversations WHERE role = 'user'",
}


def table_sql(name: str, text: str) -> None:
    """Add a derived table that later SQL may name."""
    TABLES[name] = text


def with_tables(body: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for t in TABLES:
            if t not in need and re.search(rf"(?i)\b(?:FROM|JOIN)\s+\(?\s*{t}\b", text):
                visit(TABLES[t])
                if t not in need:
                    need.append(t)

    visit(body)
    if not need:
        return body
    head = ", ".join(f"{t} AS ({TABLES[t]})" for t in need)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {head}, {rest[10:]}"
        return f"WITH {head}, {rest}"
    return f"WITH {head} {body}"


def sql_texts() -> dict[str, str]:
    """Every query's SQL with the adapter tables it names in front."""
    return {name: with_tables(text) for name, text in SQL.items()}


def load_all() -> None:
    for m in MODULES:
        name = f"gossamer.catalog.{m}"
        if importlib.util.find_spec(name):
            importlib.import_module(name)
