"""Storms: events and warnings clustered in space and time."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.plans.bucketed import bucket_of, sessions
from gossamer.plans.components import components
from gossamer.plans.spacetime import within

STORY_KM = 60.0
STORY_US = 3 * 3600 * 10**6
CELL_KM = 40.0     # a cell's diagonal stays below STORY_KM, so one cell and bucket is always one cluster


def stories_components(members: DataFrame) -> DataFrame:
    """(ref, story_id): members of a topic linked within 60 km and 3 h, directly or through others.

    Members are first combined per (topic, cell, 3 h bucket), whose members are all within reach of each other, and per
    exact place inside it with its first and last time. Links are then searched between places of neighbouring cells
    only, and only one link per pair of cells is kept; the component search sees cells, not members.
    """
    step = CELL_KM / 111.0
    m = members.withColumn("_b", bucket_of("observed_at", STORY_US))
    m = m.withColumn("_y", F.floor(F.col("lat") / step).cast("long"))
    edge = F.radians(F.least(F.greatest(F.abs(F.col("_y") * step), F.abs((F.col("_y") + 1) * step)), F.lit(89.0)))
    low = F.radians(F.least(F.abs(F.col("_y") * step), F.abs((F.col("_y") + 1) * step)))
    m = m.withColumn("_x", F.floor(F.col("lon") * F.cos(low) / step).cast("long"))
    cell = F.concat_ws("|", "topic", "_y", "_x", "_b")
    m = m.withColumn("node", F.xxhash64(cell)).drop("_y", "_x")
    places = m.groupBy("topic", "node", "_b", "lat", "lon").agg(F.min("observed_at").alias("t0"), F.max("observed_at").alias("t1"))
    radius = F.lit(STORY_KM)
    l = places.select("topic", "node", "_b", "lat", "lon", "t0", "t1", radius.alias("r"))
    # a place meets places of its own and of the next bucket; earlier ones meet it from their side
    r = places.select("topic", F.col("node").alias("o_node"), F.col("_b").alias("o_b"), F.col("lat").alias("o_lat"),
                      F.col("lon").alias("o_lon"), F.col("t0").alias("o_t0"), radius.alias("r"))
    r = r.withColumn("_b", F.explode(F.array(F.col("o_b"), F.col("o_b") - 1)))
    near_time = (F.col("o_b") == F.col("_b")) | (F.unix_micros("o_t0") - F.unix_micros("t1") <= F.lit(STORY_US))
    pairs = within(l, r, ["topic", "_b"], "r", extra=(F.col("node") != F.col("o_node")) & near_time)
    links = pairs.groupBy(F.col("node").alias("u"), F.col("o_node").alias("v")).agg(F.lit(1).alias("x")).select("u", "v")
    roots = components(links)
    lab = m.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = lab.groupBy("topic", "root").agg(F.min("ref").alias("story_id"))
    return lab.join(first, ["topic", "root"]).select("ref", "topic", "story_id", "lat", "lon", "observed_at", "severity")


def _km(a, b, c, d):
    h = (math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2)
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(h))


def replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of one block in time order: join the nearest open story within 60 km of its centroid and active in the
    last 3 h, else open one; then fold stories whose centroids have come within 60 km (the older survives)."""
    pdf = pdf.sort_values(["t", "ref"], kind="stable")
    live: dict = {}          # story -> [n, sum lat, sum lon, last t]
    moved: dict = {}
    label = []
    for lat, lon, t, ref in zip(pdf["lat"], pdf["lon"], pdf["t"], pdf["ref"]):
        for sid in [s for s, v in live.items() if v[3] < t - STORY_US]:
            del live[sid]
        best = min(((_km(lat, lon, v[1] / v[0], v[2] / v[0]), s) for s, v in live.items()), default=None)
        sid = best[1] if best is not None and best[0] <= STORY_KM else ref
        v = live.setdefault(sid, [0, 0.0, 0.0, t])
        v[0], v[1], v[2], v[3] = v[0] + 1, v[1] + lat, v[2] + lon, max(v[3], t)
        label.append(sid)
        for other in sorted(live):
            if other == sid or other not in live or sid not in live:
                continue
            a, b = live[sid], live[other]
            if _km(a[1] / a[0], a[2] / a[0], b[1] / b[0], b[2] / b[0]) > STORY_KM:
                continue
            keep, gone = min(sid, other), max(sid, other)
            k, g = live[keep], live.pop(gone)
            live[keep] = [k[0] + g[0], k[1] + g[1], k[2] + g[2], max(k[3], g[3])]
            moved[gone] = keep
            sid = keep

    def end(s):
        while s in moved:
            s = moved[s]
        return s

    return pd.DataFrame({"ref": pdf["ref"].to_numpy(), "story_id": [end(s) for s in label]})


def _replay_arrow(table):
    out = replay(table.to_pandas())
    kind = table.schema.field("ref").type
    return pa.table({"ref": pa.array(out["ref"], kind), "story_id": pa.array(out["story_id"], kind)})


BLOCK_DEG = 0.5


def merge_boxes(boxes: list[list[float]]) -> list[int]:
    """Block number per box: boxes within 60 km of each other end in one block, whose own box then counts."""
    parent = list(range(len(boxes)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    live = {i: b for i, b in enumerate(boxes)}
    lat_gap = STORY_KM / 111.0
    changed = True
    while changed:
        changed = False
        # sweep by latitude; only boxes whose latitude ranges touch are compared
        order = sorted(live, key=lambda i: live[i][0])
        open_: list[int] = []
        for i in order:
            if i not in live:
                continue
            open_ = [j for j in open_ if j in live and live[j][1] + lat_gap >= live[i][0]]
            for j in list(open_):
                a, b = live[i], live[j]
                lon_gap = STORY_KM / (111.0 * max(0.02, math.cos(math.radians(min(89.0, max(abs(a[0]), abs(a[1]), abs(b[0]), abs(b[1])) + lat_gap)))))
                if a[2] - lon_gap <= b[3] and b[2] - lon_gap <= a[3]:
                    live[i] = [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]
                    del live[j]
                    open_.remove(j)
                    parent[root(j)] = root(i)
                    changed = True
            open_.append(i)
    return [root(i) for i in range(len(boxes))]


def _block_arrow(key, table):
    cols = table.to_pydict()
    blocks = merge_boxes([list(t) for t in zip(cols["y0"], cols["y1"], cols["x0"], cols["x1"])])
    n = table.num_rows
    return pa.table({"topic": pa.array([key[0].as_py()] * n, pa.string()), "session_at": pa.array([key[1].as_py()] * n, pa.int64()),
                     "_y": table.column("_y"), "_x": table.column("_x"), "block": pa.array(blocks, pa.int64())})


def stories_replay(members: DataFrame) -> DataFrame:
    """G5, exact order-dependent form: a fold per independent block.

    Two members can meet only in a chain of activity with no silence over 3 h, so each topic is cut at those silences
    (by aggregated buckets). A storm's centre lies in the box of its members, so members whose boxes stay over 60 km
    apart cannot meet either: boxes are merged over one row per half-degree cell, a number set by the map's area.
    """
    kind = members.schema["ref"].dataType.simpleString()
    marks = sessions(members, ["topic"], "observed_at", STORY_US)
    m = members.withColumn("_b", bucket_of("observed_at", STORY_US)).join(marks, ["topic", "_b"])
    m = m.withColumn("_y", F.floor(F.col("lat") / BLOCK_DEG).cast("long")).withColumn("_x", F.floor(F.col("lon") / BLOCK_DEG).cast("long"))
    cells = m.groupBy("topic", "session_at", "_y", "_x").agg(F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
    blocks = cells.groupBy("topic", "session_at").applyInArrow(_block_arrow, "topic string, session_at long, _y long, _x long, block long")
    rows = m.join(blocks, ["topic", "session_at", "_y", "_x"]).select("topic", "session_at", "block", "ref", "lat", "lon", F.unix_micros("observed_at").alias("t"))
    return rows.groupBy("topic", "session_at", "block").applyInArrow(_replay_arrow, f"ref {kind}, story_id {kind}")


def story_rows(labelled: DataFrame, now=None) -> DataFrame:
    """Stories from labelled members: centroid, span, size, severity."""
    return labelled.groupBy("topic", "story_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n_members"), F.max("severity").alias("severity"),
        F.min("observed_at").alias("opened_at"), F.max("observed_at").alias("updated_at"))


def stories_ranked(stories: DataFrame, limit: int) -> DataFrame:
    """T2."""
    return stories.orderBy(F.desc("severity"), F.desc("updated_at"), "story_id").limit(limit)


def story_of_event(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """The storm of each event; members are named event:<id> and alert:<id>."""
    return events.withColumn("ref", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).join(labelled.select("ref", "story_id"), "ref").drop("ref")


def storm_facts(labelled: DataFrame, events: DataFrame, alerts: DataFrame, per_story: int = 5) -> DataFrame:
    """Numbered facts of each storm: its alerts in order, then its most severe events.

    Facts are ranked per storm in two levels, alerts kept whole. ``events`` (event_id, severity), ``alerts`` (alert_id, sent).
    """
    from gossamer.operators.rollups import top_per_key

    of = labelled.select("ref", "story_id")
    a = alerts.withColumn("ref", F.concat(F.lit("alert:"), F.col("alert_id").cast("string"))).join(of, "ref").select(
        "story_id", F.lit(0).alias("part"), F.unix_micros("sent").cast("double").alias("key"), F.col("alert_id").cast("string").alias("id"))
    e = story_of_event(events, labelled).select("story_id", "severity", F.col("event_id").alias("id"))
    e = top_per_key(e, ["story_id"], [F.desc("severity"), F.asc("id")], per_story, "id")
    e = e.select("story_id", F.lit(1).alias("part"), F.col("rank").cast("double").alias("key"), "id")
    return a.unionByName(e)


def template_brief(facts: DataFrame) -> DataFrame:
    """One cited phrase per fact, joined in order. Facts per story are few: alerts of one storm and at most five events."""
    phrase = F.concat(F.when(F.col("part") == 0, "alert ").otherwise("event "), F.col("id"))
    g = facts.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("part", "key", "id", phrase.alias("phrase")))).alias("f"))
    return g.select("story_id", F.array_join(F.transform("f", lambda x: x["phrase"]), "; ").alias("brief"))
