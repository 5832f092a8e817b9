"""Closest partner per reading and sensor, worked out a cell at a time in vectors.

The same cells as the range join: a row is copied to the few cells its reach touches and asks in the one it lies in. A cell's rows come to one worker,
which compares a few asking rows with all they might meet at once and hands on only what the caller keeps: counts, or the pairs themselves. Rows of one
cell are held together; the pairs of a cell never are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.geo import EARTH_KM
from gossamer.plans.spacetime import KM_PER_DEG, cells_reached, cell_keys

KEYS = ["_cy", "_cx", "_tb"]
GRAIN = 4.0
ASKS, ANSWERS, STRICT = 1, 2, 4
CELLS = 2**17  # comparisons made at once
ROWS = 2**16  # rows gathered before cells are worked out, pairs gathered before they are handed on


def _cells(rows: DataFrame, on: str, radius: str, window_us: str) -> DataFrame:
    """Each row in its own cell, the only one it asks in, and, where it answers, in all others it reaches. A cell is known by 96 bits of its names."""
    width = F.greatest(F.lit(1).cast("long"), (F.col(window_us) * F.lit(GRAIN)).cast("long"))
    asks, answers = F.col("_f").bitwiseAND(F.lit(ASKS)) > 0, F.col("_f").bitwiseAND(F.lit(ANSWERS)) > 0

    def bucket(t: Column) -> Column:
        return F.floor(t / width).cast("long")

    own = cell_keys(rows.filter(asks | answers), F.col(radius), grain=GRAIN).withColumnsRenamed({"_cy": "_y", "_cx": "_x"}).withColumn("_b", bucket(F.col("_t")))
    far = cells_reached(own, F.col(radius), grain=GRAIN)
    far = far.withColumn("_tb", F.explode(F.sequence(bucket(F.col("_t") - F.col(window_us)), bucket(F.col("_t") + F.col(window_us)))))
    here = (F.col("_cy") == F.col("_y")) & (F.col("_cx") == F.col("_x")) & (F.col("_tb") == F.col("_b"))
    far = far.withColumn("_f", F.when(here, F.col("_f")).otherwise(F.col("_f").bitwiseAND(F.lit(~ASKS)))).filter(asks | answers)
    return far.withColumns({"_cell": F.xxhash64(on, *KEYS), "_check": F.hash(on, *KEYS)}).drop("_y", "_x", "_b", on, *KEYS)


def closest(rows: DataFrame, on: str, radius: str, window_us: str, by: str, row_id: str, same: str, finish: Callable, schema: str, turns: tuple = ((None, None),)) -> DataFrame:
    """For each row that asks (bit ASKS of ``_f``) and each other value of ``by``, the answering row (ANSWERS) that came earlier by ``row_id``, lies within the radius and
    window and is closest in time (``_t``, microseconds), then newest, then latest. Where the asking row is STRICT, both have the same ``same``, null matching null.

    ``finish(table, pairs)`` gets the rows of some cells and an iterator of (asking rows, each pair's place among them, its answering row) and yields record batches of
    ``schema``. Radius and window depend on ``on`` only. Rows equal in ``by``, time and ``row_id`` go by place, then value. ``turns`` limits the work to what is
    wanted: each is (bit of the rows that ask, bit of rows: only sensors with such a row in the cell are met).
    """
    given = [on, radius, window_us, by, row_id, "lat", "lon", "_t"]
    rows = rows.filter(" AND ".join([*(f"{c} IS NOT NULL" for c in given), "NOT isnan(lat)", "NOT isnan(lon)"]))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sorted by one number: no names are compared
    cells = _cells(rows, on, radius, window_us).repartition(parts, "_cell").sortWithinPartitions("_cell")
    names = {"radius": radius, "window": window_us, "by": by, "row": row_id, "same": same}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_cells(batches):
            yield from finish(table, _pairs(table, starts, names, turns))

    return cells.mapInArrow(run, schema)


def _whole_cells(batches):
    """(table, starts of its cells): rows come sorted by cell, a table ends where a cell does."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("_cell").to_numpy()
        if n and n + batch.num_rows >= ROWS:
            ends = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if ends or held[-1].column("_cell")[-1].as_py() != cell[0]:
                yield _sorted(pa.Table.from_batches([*held, batch.slice(0, ends)]))
                held, n, batch = [], 0, batch.slice(ends)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield _sorted(pa.Table.from_batches(held))


def _sorted(table):
    cell, check = table.column("_cell").to_numpy(), table.column("_check").to_numpy()
    new = np.append(True, cell[1:] != cell[:-1])
    mixed = check[1:] != check[:-1]
    if (mixed & ~new[1:]).any():  # two cells share the 64 bits
        order = np.lexsort((check, cell))
        return _sorted(table.take(pa.array(order))) if (order != np.arange(len(order))).any() else (table, np.flatnonzero(np.append(True, new[1:] | mixed)))
    return table, np.flatnonzero(new)


def _codes(column) -> np.ndarray:
    """Equal values get equal numbers, null one of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def floats(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there is one."""
    c = table.column(name).cast(pa.float64())
    return pc.fill_null(c, 0.0).to_numpy(), pc.is_valid(c).to_numpy()


def has(table, bit: int) -> np.ndarray:
    return (table.column("_f").to_numpy() & bit) > 0


def haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    """X1 on vectors, operation by operation as in ``functions.geo``."""
    half_dp = np.sin((np.radians(lat2) - np.radians(lat1)) / 2)
    half_dl = np.sin(np.radians(lon2 - lon1) / 2)
    a = half_dp * half_dp + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_dl * half_dl
    return (2 * EARTH_KM) * np.arcsin(np.sqrt(a))


def _pairs(table, starts, names, turns):
    """(asking rows, each pair's place among them, its answering row), some asking rows of one cell at a time."""
    t, w = table.column("_t").to_numpy(), table.column(names["window"]).to_numpy()
    lat, lon, radius = (floats(table, c)[0] for c in ("lat", "lon", names["radius"]))
    row, by, same = table.column(names["row"]).to_numpy(), _codes(table.column(names["by"])), _codes(table.column(names["same"]))
    strict, asks, answers = (has(table, bit) for bit in (STRICT, ASKS, ANSWERS))
    value, valued = floats(table, "value")
    phi, lam = np.radians(lat), np.radians(lon)
    at = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])
    # the cosine of the angle tells near from far but for a sliver, where the distance itself is taken
    least = np.cos(np.minimum(radius / EARTH_KM, math.pi))
    who_about = [tuple(bit and has(table, bit) for bit in turn) for turn in turns]
    ends = np.append(starts[1:], table.num_rows)
    for s, e in zip(starts, ends):
        asking, answering = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(answers[s:e])
        if not len(asking) or not len(answering):
            continue
        # rows of one sensor stand together, of equally close ones the better later: by time, then row, then against the order of place and value
        answering = answering[np.lexsort((-value[answering], ~valued[answering], -lon[answering], -lat[answering], row[answering], t[answering], by[answering]))]
        cell = _Cell(t, w, lat, lon, radius, row, by, same, strict, at, least)
        for who, about in who_about:
            ask = asking if who is None else asking[who[asking]]
            met = answering if about is None else answering[np.isin(by[answering], by[answering[about[answering]]])]
            if len(ask) and len(met):
                yield from cell.pairs(ask, met)


class _Cell:
    """Rows of one cell, as places in the table's columns. Times, rows and sensors are compared by their ranks in it, which are half as wide."""

    def __init__(self, t, w, lat, lon, radius, row, by, same, strict, at, least):
        self.t, self.w, self.lat, self.lon, self.radius, self.row, self.by, self.same, self.strict, self.at, self.least = t, w, lat, lon, radius, row, by, same, strict, at, least

    def pairs(self, ask, met):
        t, w, row, by, same = self.t, self.w, self.row, self.by, self.same
        ask = ask[np.argsort(t[ask], kind="stable")]
        times, rows, sensors = np.sort(t[met]), np.sort(row[met]), np.unique(by[met])
        # a met row's rank of time, row and sensor; of an asking row the first and last time, the first row too late and its own sensor's rank
        self.mt, self.mr, self.mb = (np.searchsorted(v, x).astype(np.int32) for v, x in ((times, t[met]), (rows, row[met]), (sensors, by[met])))
        self.a0, self.a1 = np.searchsorted(times, t[ask] - w[ask]).astype(np.int32), np.searchsorted(times, t[ask] + w[ask], "right").astype(np.int32)
        self.ar, b = np.searchsorted(rows, row[ask]).astype(np.int32), np.searchsorted(sensors, by[ask])
        self.ab = np.where((b < len(sensors)) & (sensors[np.minimum(b, len(sensors) - 1)] == by[ask]), b, -1).astype(np.int32)
        codes = np.unique(same[np.concatenate([ask, met])])
        self.ms, self.as_ = np.searchsorted(codes, same[met]).astype(np.int32), np.searchsorted(codes, same[ask]).astype(np.int32)
        self.ask, self.met, self.mat = ask, met, self.at[:, met]
        for group in self._groups():
            yield from self._group(group)

    def _groups(self):
        """Asking rows in groups close in space, each ordered by time."""
        ask = self.ask
        if len(ask) <= 48:
            return [np.arange(len(ask))]
        h = np.maximum(self.radius[ask], 1e-9) / KM_PER_DEG
        y = np.floor(self.lat[ask] / h)
        x = np.floor(self.lon[ask] * np.maximum(np.cos(np.radians(y * h)), 0.01) / h)
        order = np.lexsort((np.arange(len(ask)), x, y))
        return np.split(order, np.flatnonzero((np.diff(y[order]) != 0) | (np.diff(x[order]) != 0)) + 1)

    def _group(self, group):
        rows, met = self.ask[group], self.met
        reach = self.radius[rows].max() / KM_PER_DEG
        low, high = self.lat[rows].min() - reach, self.lat[rows].max() + reach
        # no farther east or west than the radius spans at the edge toward the pole
        wide = self.radius[rows].max() / (KM_PER_DEG * math.cos(math.radians(min(max(abs(low), abs(high)), 89.0))))
        west, east = self.lon[rows].min() - wide, self.lon[rows].max() + wide
        lat, lon = self.lat[met], self.lon[met]
        near = np.flatnonzero((lat >= low) & (lat <= high) & (lon >= west) & (lon <= east))
        if not len(near):
            return
        mt, i = self.mt[near], 0
        while i < len(group):
            n = min(64, len(group) - i)
            while True:
                g = group[i:i + n]
                r = near[(mt >= self.a0[g].min()) & (mt < self.a1[g].max())]
                if n == 1 or n * len(r) <= 2 * CELLS:
                    break
                n = max(1, n // 2)
            i += n
            if len(r):
                yield from self._chunk(g, r)

    def _chunk(self, g, r):
        ask, met = self.ask[g], self.met[r]
        dot = self.at[:, ask].T @ self.mat[:, r]
        ok = dot >= (self.least[ask] - 1e-12)[:, None]
        mt = self.mt[r]
        ok &= mt >= self.a0[g][:, None]
        ok &= mt < self.a1[g][:, None]
        ok &= self.mr[r] < self.ar[g][:, None]
        ok &= self.mb[r] != self.ab[g][:, None]
        need = self.strict[ask]
        if need.any():
            ok &= (self.ms[r] == self.as_[g][:, None]) | ~need[:, None]
        flat = np.flatnonzero(ok)
        if not len(flat):
            return
        k, p = np.divmod(flat.astype(np.int32), np.int32(len(r))) if ok.size < 2**31 else np.divmod(flat, len(r))
        # the sliver at the edge
        edge = dot.ravel()[flat] < (self.least[ask] + 1e-12)[k]
        if edge.any():
            q = np.flatnonzero(edge)
            keep = np.ones(len(k), bool)
            i, j = ask[k[q]], met[p[q]]
            keep[q] = haversine_km(self.lat[i], self.lon[i], self.lat[j], self.lon[j]) <= self.radius[i]
            k, p = k[keep], p[keep]
            if not len(k):
                return
        b = self.mb[r][p]
        new = np.empty(len(k), bool)
        new[0] = True
        np.not_equal(b[1:], b[:-1], out=new[1:])
        new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        if len(first) < len(k):
            # of several rows of one sensor: least time apart, of equal ones the last in order
            gap = np.abs(self.t[met][p] - self.t[ask][k])
            run = np.cumsum(new, dtype=np.int32) - 1
            best = np.flatnonzero(gap == np.minimum.reduceat(gap, first)[run])
            best = best[np.append(run[best][1:] != run[best][:-1], True)]
            k, p = k[best], p[best]
        yield ask, k, met[p]
