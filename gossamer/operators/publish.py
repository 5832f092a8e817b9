"""Published tables and messages; upserts, retention and deletion as rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import scalars as X
from gossamer.operators.filters import hours_before

# The columns of the digest's tables.
DIGEST_TABLES = {
    "events": ["opened_at", "updated_at", "topic", "metric", "metric_label", "title", "county_label", "county_fips", "zip5", "lat", "lon", "peak_value", "unit",
               "peak_display", "score", "severity", "n_signals", "n_sensors", "n_reference", "mean_trust", "verified", "status"],
    "official-alerts": ["event", "severity", "counties", "sent", "expires", "sender", "headline", "url"],
    "county-activity": ["county", "county_fips", "topic", "metric", "metric_key", "n", "n_human", "n_sensors", "mean", "max", "latest"],
    "station-extremes": ["metric", "how", "value", "county", "n"],
    "contributors": ["name", "county", "trust", "n", "n_corr"],
    "reading-list": ["published_at", "feed", "title", "relevance", "reason", "url"],
    "network-vitals": ["metric", "value"],
}


def cell_text(df: DataFrame, name: str) -> Column:
    """A value as a table cell: lists joined by '; ', booleans yes or no, missing empty."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        out = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "yes").otherwise("no")
        out = F.when(c.isNotNull(), out)
    elif isinstance(kind, T.TimestampType):
        out = X.iso(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def digest_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """K1's rows: the fixed columns as text; one a table lacks stays empty."""
    return df.select(*[cell_text(df, c).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_digest_tables(tables: dict[str, DataFrame], path: str) -> None:
    """K1: every table of the digest as CSV with its header, empty ones included."""
    for name, columns in DIGEST_TABLES.items():
        df = tables[name]
        digest_cells(df, columns).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_snapshot_json(sections: dict[str, DataFrame], path: str) -> None:
    """K2: one folder of JSON documents per section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def feature(id_: Column, lat: Column, lon: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
                              properties.alias("properties")))


def events_geojson(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """K3: verified events of a week at public points, one GeoJSON feature per line."""
    e = events.filter(F.col("verified") & (F.col("updated_at") >= hours_before(now, days * 24)) & F.col("pub_lat").isNotNull())
    p = F.struct("topic", "metric", "peak", "county_id", X.iso("opened_at").alias("opened_at"), X.iso("updated_at").alias("updated_at"), "status",
                 F.col("witnesses").alias("sensors"), F.col("n_reference").alias("official_sources"), "severity", "score")
    return e.select("event_id", feature(F.col("event_id"), F.col("pub_lat"), F.col("pub_lon"), p).alias("feature"))


def storms_geojson(members: DataFrame, stories: DataFrame) -> DataFrame:
    """K4: storms at the mean of their members' public points. ``members`` (story_id, pub_lat, pub_lon)."""
    g = members.filter(F.col("pub_lat").isNotNull()).groupBy("story_id").agg(F.avg("pub_lat").alias("la"), F.avg("pub_lon").alias("lo"))
    s = stories.join(g, "story_id")
    p = F.struct("topic", "severity", "n_members", X.iso("opened_at").alias("opened_at"), X.iso("updated_at").alias("updated_at"))
    return s.select("story_id", feature(F.col("story_id"), F.bround("la", 4), F.bround("lo", 4), p).alias("feature"))


def cap_time(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-00:00'")


CAP_NAMESPACE = "urn:oasis:names:tc:emergency:cap:1.2"


def cap_rows(events: DataFrame, sender: str, network: str, description: str = "{label}: peak {peak}; people {people}, official sources {sources}",
             note: str = "Readings of a sensor network, not an official warning", page: str | None = None) -> DataFrame:
    """K5: one CAP 1.2 message per verified event, as XML text per row. ``description`` may name label, peak, people and sources; ``page`` may name id."""
    host = sender.split("@")[-1]
    sev = F.when(F.col("severity") >= 0.8, "Severe").when(F.col("severity") >= 0.5, "Moderate").otherwise("Minor")
    people = F.greatest(F.lit(0), F.col("n_sensors") - F.col("n_reference_sensors"))
    facts = {"label": F.col("label"), "peak": F.concat_ws(" ", X.nice_number("peak"), F.col("unit") if "unit" in events.columns else F.lit(None)), "people": people, "sources": F.col("n_reference")}
    desc = F.lit(description)
    for name, value in facts.items():
        desc = F.replace(desc, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    par = lambda n, v: F.struct(F.lit(n).alias("valueName"), v.cast("string").alias("value"))
    geocode = F.array(*[F.struct(F.lit(n).alias("valueName"), F.concat(F.lit("0"), "county_id").alias("value")) for n in ("SAME", "FIPS6")])
    info = F.struct(
        F.lit("en-US").alias("language"), F.col("category").alias("category"), F.concat("label", F.lit(" (network observation)")).alias("event"),
        F.when(F.col("status") == "closed", "Past").otherwise("Unknown").alias("urgency"), sev.alias("severity"), F.lit("Observed").alias("certainty"),
        cap_time("opened_at").alias("effective"), cap_time("opened_at").alias("onset"), cap_time(F.col("updated_at") + F.expr("INTERVAL 6 HOURS")).alias("expires"),
        F.lit(network).alias("senderName"), F.col("title").alias("headline"), desc.alias("description"), *([F.replace(F.lit(page), F.lit("{id}"), F.col("event_id").cast("string")).alias("web")] if page else []),
        F.array(par("NetworkEventID", F.col("event_id")), par("Metric", F.col("metric")), par("Peak", F.col("peak")), par("Sensors", F.col("witnesses")), par("OfficialSources", F.col("n_reference")),
                par("Score", F.col("score"))).alias("parameter"),
        F.struct(F.col("county_name").alias("areaDesc"), F.concat_ws(" ", F.concat_ws(",", "pub_lat", "pub_lon"), F.col("radius_km").cast("string")).alias("circle"), geocode.alias("geocode")).alias("area"))
    ident = F.concat(F.lit(f"{host}.event."), F.col("event_id"))
    alert = F.struct(F.lit(CAP_NAMESPACE).alias("_xmlns"), F.concat(ident, F.lit("."), F.date_format("updated_at", "yyyyMMdd'T'HHmmss")).alias("identifier"), F.lit(sender).alias("sender"), cap_time("updated_at").alias("sent"),
                     F.lit("Actual").alias("status"), F.lit("Alert").alias("msgType"), F.lit("Public").alias("scope"),
                     F.lit(note).alias("note"), ident.alias("incidents"), info.alias("info"))
    return events.filter("verified").select("event_id", F.to_xml(alert, {"rowTag": "alert"}).alias("cap"))


def research_readings(signals: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """K6, readings: people's and official rows; people's points are dropped and their ids become handles."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, days * 24)) & ~F.col("metric").startswith("alert.") & (X.is_people() | (F.col("kind") == "official")))
    who = F.when(X.is_reference(), F.col("sensor_id").cast("string")).otherwise(X.public_handle("sensor_id"))
    keep = lambda c: F.when(X.is_reference(), F.col(c))
    return s.select("seq", "topic", "metric", "value", "observed_at", "received_at", who.alias("sensor"), F.col("kind").alias("sensor_kind"), "county_id", "zip5",
                    keep("lat").alias("lat"), keep("lon").alias("lon"), "quality")


def with_events(readings: DataFrame, members: DataFrame) -> DataFrame:
    """K6: the readings with the event each belongs to, if any (``members``: seq, event_id)."""
    return readings.join(members.select("seq", "event_id"), "seq", "left")


def research_events(events: DataFrame, now: Column, days: int = 90, units: DataFrame | None = None, story_of: DataFrame | None = None) -> DataFrame:
    """K6, events: one row per event of the last ``days``, at its county's public point; a closed event ended with its last reading. ``units`` (metric, unit), a row
    per measure of the packs, and ``story_of`` (event_id, story_id) fill their columns, which are null without them."""
    e = events.filter(F.col("updated_at") >= hours_before(now, days * 24))
    e = e.withColumn("unit", F.lit(None).cast("string")) if units is None else e.join(F.broadcast(units.select("metric", "unit")), "metric", "left")
    e = e.withColumn("story_id", F.lit(None).cast("string")) if story_of is None else e.join(story_of.select("event_id", "story_id"), "event_id", "left")
    return e.select("event_id", "topic", "metric", "county_id", F.col("pub_lat").alias("lat"), F.col("pub_lon").alias("lon"), "opened_at", "updated_at", F.when(F.col("status") == "closed", F.col("updated_at")).alias("closed_at"),
                    F.col("peak").alias("peak_value"), "unit", "n_signals", "n_sensors", "n_reference", "severity", "score", "status", "title", "story_id")


def research_storms(stories: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """K6, storms: one row per storm of the last ``days``; storms merged into another are not listed. Columns of ``stories`` pass as they are."""
    merged = F.col("merged_into").isNull() if "merged_into" in stories.columns else F.lit(True)
    return stories.filter((F.col("updated_at") >= hours_before(now, days * 24)) & merged).drop("merged_into")


def research_alerts(threads: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """K6, alerts: one row per thread opened in the last ``days``, all its updates folded in."""
    reason = F.col("ended_reason") if "ended_reason" in threads.columns else F.when(F.col("status") == "ended", "expired")
    return threads.filter(F.col("opened_at") >= hours_before(now, days * 24)).select("thread_id", "severity", "counties", "opened_at", "ended_at", reason.alias("ended_reason"), "status")


def research_sensors(sensors: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """K6, sensors: active people by handle with their home county, and official ones by id; with ``readings`` how many they sent, how many of
    these were corroborated or contradicted (flagged), and their trust to three places, 0.5 where none is known."""
    s = sensors.filter((F.col("status") == "active") & (X.is_people() | (F.col("kind") == "official")))
    out = s.select("sensor_id", F.when(X.is_reference(), F.col("sensor_id").cast("string")).otherwise(X.public_handle("sensor_id")).alias("sensor"), "kind", "county_id",
                   F.round(F.coalesce(F.col("trust_prior"), F.lit(X.TRUST_PRIOR)), 3).alias("trust"))
    if readings is None:
        return out.select("sensor", "kind", "county_id")
    n = readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("quality") == "corroborated").alias("n_corroborated"), F.count_if(F.col("quality") == "flagged").alias("n_contradicted"))
    return out.join(n, "sensor_id", "left").fillna(0, ["n_signals", "n_corroborated", "n_contradicted"]).select("sensor", "kind", "county_id", "n_signals", "n_corroborated", "n_contradicted", "trust")


def write_research_tables(tables: dict[str, DataFrame], path: str) -> None:
    """K6: readings, events, storms, alerts, sensors, counties and metrics as Parquet; readings partitioned by topic."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("topic") if name == "readings" else w).parquet(f"{path}/{name}")


def append_run_log(rows: DataFrame, sink, source: str, path: str) -> DataFrame:
    """K7: run ``sink`` on the rows while counting them, and append one run row (fetched, new, status, error)."""
    import time

    from pyspark.sql import Observation

    spark = rows.sparkSession
    seen = Observation(f"run-{source}")
    watched = rows.observe(seen, F.count(F.lit(1)).alias("fetched"), F.count_if("is_new").alias("new"))
    start, status, error, got = time.time(), "ok", None, {"fetched": 0, "new": 0}
    try:
        sink(watched)
        got = seen.get
    except Exception as exc:  # noqa: BLE001  a failed run is logged, then raised
        status, error = "error", type(exc).__name__
        raise
    finally:
        run = spark.createDataFrame([(source, int(got["fetched"]), int(got["new"]), int((time.time() - start) * 1000), status, error)],
                                    "source string, fetched long, new long, ms long, status string, error string").withColumn("run_at", F.current_timestamp())
        run.write.mode("append").parquet(path)
    return run


def upsert_dimension(current: DataFrame, incoming: DataFrame, key: str, counters: list[str], order: str) -> DataFrame:
    """K8: newest attributes per key; counters keep the stored value. One aggregation, no lookup per row."""
    cols = [c for c in current.columns if c not in (key, *counters)]
    old = current.select(key, *cols, *counters, F.lit(0).alias("_new"))
    new = incoming.select(key, *cols, *[F.lit(None).cast(current.schema[c].dataType).alias(c) for c in counters], F.lit(1).alias("_new"))
    g = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_new", order)).alias("r"), *[F.max(c).alias(c) for c in counters])
    return g.select(key, "r.*", *[F.coalesce(c, F.lit(0).cast(current.schema[c].dataType)).alias(c) for c in counters])


def prune_signals(signals: DataFrame, event_members: DataFrame, now: Column, days: float) -> DataFrame:
    """K9: drop reference rows older than the limit that belong to no event."""
    old = X.is_reference() & (F.col("observed_at") < hours_before(now, days * 24))
    return signals.filter(~old).unionByName(signals.filter(old).join(event_members.select("seq"), "seq", "left_semi").select(*signals.columns))


def prune_outbox(outbox: DataFrame, now: Column, days: float) -> DataFrame:
    return outbox.filter((F.col("status") == "pending") | (F.col("created_at") >= hours_before(now, days * 24)))


def prune_run_log(run_log: DataFrame, now: Column, days: float) -> DataFrame:
    return run_log.filter(F.col("run_at") >= hours_before(now, days * 24))


def prune_threads(threads: DataFrame, now: Column, days: float) -> DataFrame:
    return threads.filter(~((F.col("status") == "ended") & (F.col("ended_at") < hours_before(now, days * 24))))


def rewritten(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Each table written whole to a new folder and read from there; the caller swaps the folders. The old files stay readable until then."""
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return out


def forget_sensor(tables: dict[str, tuple[DataFrame, str]], forgotten: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of forgotten people. ``tables`` maps a name to (frame, the column of
    ``forgotten`` it is keyed by: sensor_id or chat_id); pair tables list both ends as 'a|b'."""
    out = {}
    for name, (df, key) in tables.items():
        if key == "a|b":
            for side in ("a", "b"):
                df = df.join(forgotten.select(F.col("sensor_id").alias(side)), side, "left_anti")
        else:
            df = df.join(forgotten.select(key), key, "left_anti")
        out[name] = df
    return out
