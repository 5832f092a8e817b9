"""Vocabulary packs (YAML) to dimension tables. A pack is configuration of a few dozen metrics, read once by the driver."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.plans.bounded import bounded_rows
from gossamer.sources.adapter import METRIC_SCHEMA

ARITHMETIC = re.compile(r"^[\sx0-9.+\-*/()eE]*$")


def load_packs(*paths: str | Path) -> list[dict[str, Any]]:
    """Packs from files or folders of ``*.yaml``."""
    import yaml

    files: list[Path] = []
    for p in map(Path, paths):
        files += sorted(p.glob("*.yaml")) if p.is_dir() else [p]
    return [{"topic": f.stem, **(yaml.safe_load(f.read_text(encoding="utf-8")) or {})} for f in files]


def linear_units(spark: SparkSession, packs: list[dict[str, Any]]) -> dict[str, tuple[float, float] | None]:
    """(a, b) with canonical = a x + b for every unit expression of the packs that is linear in x, else None.

    One tiny job evaluates all of them at 0, 1 and 2 in decimals; powers stay expressions.
    """
    specs = [u for p in packs for m in (p.get("metrics") or {}).values() for u in ((m or {}).get("units") or {}).values() if isinstance(u, dict)]
    exprs = sorted({str(u["expr"]) for u in specs})
    for e in exprs:
        if not ARITHMETIC.match(e):
            raise ValueError(f"unsupported unit expression: {e!r}")
    plain = [e for e in exprs if "**" not in e]
    out: dict[str, tuple[float, float] | None] = dict.fromkeys(exprs)
    if plain:
        at = lambda e, v: F.expr(re.sub(r"\bx\b|x", f"cast({v} as decimal(20,10))", e)).cast("decimal(38,18)")
        row = spark.range(1).select(*[at(e, v) for e in plain for v in (0, 1, 2)]).first()
        for i, e in enumerate(plain):
            zero, one, two = row[3 * i:3 * i + 3]
            a = one - zero
            if abs(two - one - a) < 1e-9:
                out[e] = (float(a), float(zero))
    return out


def frames(spark: SparkSession, packs: list[dict[str, Any]]) -> dict[str, DataFrame]:
    """dim_metric, dim_unit, dim_word, dim_alias, dim_alert_support, dim_source_map."""
    metrics, units, words, aliases, news, support, sources = [], [], [], [], [], [], []
    known = linear_units(spark, packs)
    for pack in packs:
        topic = str(pack["topic"])
        for key, m in (pack.get("metrics") or {}).items():
            m = m or {}
            lo, hi = m.get("range") or (None, None)
            tol = m.get("tolerance") or {}
            head = m.get("headline") or {}
            flag = m.get("kind") == "flag"
            fl = lambda v: None if v is None else float(v)
            metrics.append((key, topic, str(m.get("label", key)), float(m.get("radius_km", 20)), int(m.get("window_min", 60)), fl(tol.get("abs")),
                            fl(tol.get("rel")), fl(lo), fl(hi), str(m.get("event_direction", "above")), bool(m.get("accumulates", False)), flag,
                            bool(m.get("scored", True)), [(float(a), float(s)) for a, s in m.get("event") or []],
                            next(iter(head), None), fl(m.get("headline_min"))))
            default = str(m.get("default_unit", "")).lower()
            for u, spec in (m.get("units") or {}).items():
                ab = known[str(spec["expr"])] if isinstance(spec, dict) else (float(spec), 0.0)
                units.append((key, str(u).lower(), *(ab or (None, None)), None if ab else str(spec["expr"]), str(u).lower() == default))
            words += [(key, str(w).lower(), float(v)) for w, v in (m.get("words") or {}).items()]
            aliases += [(key, str(a).lower(), flag) for a in [key, *(m.get("aliases") or [])]]
            news += [(key, str(w).lower()) for w in [*(m.get("news_words") or []), *(a for a in m.get("aliases") or [] if " " in str(a).strip())]]
        support += [(k, str(s)) for k, ss in (pack.get("alert_support") or {}).items() for s in ss]
        for table, rows in pack.items():
            if isinstance(rows, dict) and table.rsplit("_", 1)[-1] in ("elements", "parameters", "types", "fields", "codes"):
                for code, spec in rows.items():
                    if isinstance(spec, dict) and (spec.get("metric") or spec.get("basis")):
                        sources.append((table, str(code), str(spec.get("metric") or spec.get("basis")), spec.get("unit"), spec.get("period")))
    mk = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "dim_metric": spark.createDataFrame(metrics, METRIC_SCHEMA),
        "dim_unit": mk(units, "metric string, unit string, a double, b double, expr string, is_default boolean"),
        "dim_word": mk(words, "metric string, word string, value double"),
        "dim_alias": mk(aliases, "metric string, alias string, is_flag boolean"),
        "dim_news_word": mk(news, "metric string, name string"),
        "dim_alert_support": mk(support, "metric string, slug string"),
        "dim_source_map": mk(sources, "feed string, code string, metric string, unit string, period string"),
    }


# A vocabulary with more distinct unit expressions than this is refused.
MAX_EXPRESSIONS = 10_000


def convert_unit(df: DataFrame, dim_unit: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """raw_value with a typed unit to the canonical value; no unit means the metric's default; a flag is 1.

    Adds ``value`` and ``error``. Linear units are a x + b from the joined row; the dimension is a literal of the packs.
    """
    u = dim_unit.select("metric", F.col("unit").alias("_u"), "a", "b", "expr", "is_default")
    typed = F.lower(F.coalesce(F.col("unit"), F.lit("")))
    flags = F.broadcast(dim_metric.select("metric", "is_flag"))
    out = df.join(flags, "metric", "left")
    default = F.broadcast(u.filter("is_default").select("metric", F.col("_u").alias("_d")))
    out = out.join(default, "metric", "left").withColumn("_t", F.when(typed == "", F.coalesce("_d", F.lit(""))).otherwise(typed))
    out = out.join(F.broadcast(u.select(F.col("metric").alias("_m"), "_u", "a", "b", "expr")), (F.col("_m") == F.col("metric")) & (F.col("_u") == F.col("_t")), "left")
    value = F.when(F.col("is_flag"), 1.0).when(F.col("a").isNotNull(), F.col("a") * F.col("raw_value") + F.col("b")).when(F.col("_t") == "", F.col("raw_value"))
    for expr in sorted(r["expr"] for r in bounded_rows(dim_unit.filter("expr is not null").select("expr").distinct(), MAX_EXPRESSIONS)):
        value = value.when(F.col("expr") == expr, F.expr(re.sub(r"\bx\b", "raw_value", expr.replace("**", "^")) if "**" not in expr else _power(expr)))
    out = out.withColumn("value", value)
    bad = F.col("value").isNull() & F.col("raw_value").isNotNull()
    return out.withColumn("error", F.when(bad, F.concat(F.lit("unknown unit "), "_t", F.lit(" for "), "metric"))).drop("_t", "_d", "_m", "_u", "a", "b", "expr")


def _power(expr: str) -> str:
    """``a ** b`` as power(a, b) for simple operands."""
    return re.sub(r"([\w.()]+)\s*\*\*\s*([\w.()]+)", r"power(\1, \2)", expr).replace("x", "raw_value")
