"""Queries that larger tables broke: the same rows as plain Python, by plans whose cost grows with the rows."""

import math
import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.functions import exprs as C
from tankline.operators import geo, joins, windows
from tankline.sources import invoices

T0 = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_is_one_sorted_pass(spark):
    """Keys with many plan stops, keys cut by batches, rows without a key; every figure goes along with its row."""
    rng = random.Random(5)
    key = lambda: (rng.choice([None, 1, 2, 3]), date(2024, 1, 1) + timedelta(rng.randrange(2)), rng.choice([None, 7, 8]))
    planned = [(*key(), 1000 + i, T0 + timedelta(minutes=rng.randrange(40)), 20 + i) for i in range(120)]
    actual = [(*key(), i, T0 + timedelta(minutes=rng.randrange(40)), i % 23 == 5, 100 + i, 30 + i % 7) for i in range(200)]
    p = spark.createDataFrame(planned, "truck_id long, day date, station_id long, plan_stop_id long, dispatched_at timestamp, price_t long")
    a = spark.createDataFrame(actual, "truck_id long, day date, station_id long, stop_id long, occurred_at timestamp, split_fill boolean, qty_c long, billed_t long")
    fills = [r for r in actual if r[2] is not None and not r[5]]
    taken, wanted = set(), []
    for truck, day, station, i, at, price in sorted(planned, key=lambda r: (r[4], r[3])):
        if truck is None:
            continue
        free = [(abs(r[4] - at), r[4], r[3], r[6], r[7]) for r in fills if r[:3] == (truck, day, station) and station is not None and r[3] not in taken]
        if free:
            _, _, stop, qty, billed = min(free)
            taken.add(stop)
            wanted.append((truck, day, station, i, stop, "matched", price * qty, billed * qty, (billed - price) * qty))
        else:
            wanted.append((truck, day, station, i, None, "skipped_recommendation", None, None, None))
    wanted += [(*r[:3], None, r[3], "unplanned_stop", None, None, None) for r in fills if r[3] not in taken]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = joins.match_deltas(p, a)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(wanted) and set(rows) == set(wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(r[5] == "matched" for r in wanted)
    plan = plan_of(joins.plan_actual(p, a))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "Join" not in plan


def test_long_lane_is_reprojected_in_passes(spark):
    """A lane of 60,000 positions with anchors at its ends: minutes if each row read the rest of the lane."""
    n = 60_000
    rows = spark.range(n + 1).select(F.lit(1).alias("lane"), F.col("id").cast("double").alias("old"), F.when(F.col("id") % n == 0, F.col("id") / 2.0).alias("anchor"))
    began = time.monotonic()
    moved = windows.reproject(rows, "lane", "old", "old", "anchor")
    assert moved.where(F.abs(F.col("moved") - F.col("old") / 2) > 1e-6).isEmpty() and moved.count() == n + 1
    assert time.monotonic() - began < 20


def test_reprojection_against_interpolation(spark):
    rng = random.Random(8)
    rows = [(lane, float(old), rng.choice([None, None, old * 3.0])) for lane in range(5) for old in rng.sample(range(100), 30)]
    got = {(r.lane, r.old): r.moved for r in windows.reproject(spark.createDataFrame(rows, "lane int, old double, anchor double"), "lane", "old", "old", "anchor").collect()}
    for lane, old, _ in rows:
        known = sorted((o, a) for k, o, a in rows if k == lane and a is not None)
        low, high = [x for x in known if x[0] <= old], [x for x in known if x[0] >= old]
        wanted = low[-1][1] if not high else high[0][1] if not low else old * 3.0
        assert abs(got[lane, old] - wanted) < 1e-9


@pytest.mark.parametrize("on_spheroid", [False, True])
def test_pruned_pieces_hold_the_nearest(on_spheroid):
    """Against all pieces: the nearest in miles and the nearest in degrees are kept, and few others."""
    rng = np.random.default_rng(3)
    for at in (0.0, 40.0, 58.0):
        piece = {"lat": at + rng.uniform(-1, 1, 400), "lng": rng.uniform(-101, -99, 400)}
        piece |= {"lat2": piece["lat"] + rng.uniform(-0.1, 0.1, 400), "lng2": piece["lng"] + rng.uniform(-0.1, 0.1, 400)}
        lat, lng = at + rng.uniform(-1.5, 1.5, 300), rng.uniform(-101.5, -98.5, 300)
        dy, dx = (piece[b] - piece[a] for a, b in (("lat", "lat2"), ("lng", "lng2")))
        t = np.clip(((lat[:, None] - piece["lat"]) * dy + (lng[:, None] - piece["lng"]) * dx) / (dy * dy + dx * dx), 0, 1)
        y, x = piece["lat"] + t * dy, piece["lng"] + t * dx
        off = (lat[:, None] - y) ** 2 + (lng[:, None] - x) ** 2
        a = np.sin(np.radians(y - lat[:, None]) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(lat[:, None])) * np.sin(np.radians(x - lng[:, None]) / 2) ** 2
        miles = 2 * 3958.8 * np.arcsin(np.sqrt(a))
        i, j = geo.nearest_pieces(piece, lat, lng, 20.0, on_spheroid)
        kept = set(zip(i.tolist(), j.tolist(), strict=True))
        near = miles.min(1) <= 20
        best = off if on_spheroid else miles
        assert all((s, int(best[s].argmin())) in kept for s in np.flatnonzero(near)) and len(kept) < 8 * 300


def sphere(lat, lng, y, x):
    h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(lat)) * math.sin(math.radians(x - lng) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("on_spheroid", [False, True])
def test_corridor_of_a_dense_route(spark, on_spheroid):
    """A route that crosses itself all over a region: what all pieces give, by a plan that joins no pieces with stations."""
    rng = random.Random(2)
    spots = [(i, 35 + rng.random() * 5, -100 + rng.random() * 5) for i in range(60)]
    route = [(7, i, 35 + rng.random() * 5, -100 + rng.random() * 5) for i in range(40)]
    r, s = spark.createDataFrame(route, "lane long, seq int, lat double, lng double"), spark.createDataFrame(spots, "station_id long, other_lat double, other_lng double")
    found = geo.corridor(r, s, "lane", "seq", 30.0, on_spheroid=on_spheroid)
    plan = plan_of(found)
    assert "MapInArrow" in plan and "lambda" not in plan
    got = {x.station_id: (x.perp_miles, x.fraction) for x in found.collect()}
    lengths = [((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2) ** 0.5 for a, b in zip(route, route[1:], strict=False)]
    pieces = []
    for k, (a, b) in enumerate(zip(route, route[1:], strict=False)):
        n = max(1, math.ceil(sphere(a[2], a[3], b[2], b[3]) / 25.0))
        cut = [(a[2] + (b[2] - a[2]) * q / n, a[3] + (b[3] - a[3]) * q / n) for q in range(n + 1)]
        pieces += [(*cut[q], *cut[q + 1], sum(lengths[:k]) + lengths[k] * q / n, lengths[k] / n) for q in range(n)]
    for i, lat, lng in spots:
        best = []
        for y1, x1, y2, x2, before, length in pieces:
            t = max(0.0, min(1.0, ((lat - y1) * (y2 - y1) + (lng - x1) * (x2 - x1)) / length**2))
            y, x = y1 + t * (y2 - y1), x1 + t * (x2 - x1)
            miles = sphere(lat, lng, y, x)
            best.append(((lat - y) ** 2 + (lng - x) ** 2 if on_spheroid else miles, (before + t * length) / sum(lengths), miles))
        _, fraction, miles = min(best)
        if miles < 29 / 1.5:
            assert abs(got[i][1] - fraction) < 1e-7 and (on_spheroid or abs(got[i][0] - miles) < 1e-6)
            assert got[i][0] <= miles * 1.01


def test_compiled_spheroid_distance_is_the_formula(spark):
    rng = random.Random(9)
    spots = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(300)]
    rows = [(*a, a[0] + rng.uniform(-3, 3), a[1] + rng.uniform(-3, 3)) for a in spots] + [(1.0, 2.0, 1.0, 2.0), (None, 1.0, 2.0, 3.0), (10.0, 179.9, 10.0, -179.9)]
    df = spark.createDataFrame(rows, "lat double, lng double, other_lat double, other_lng double")
    both = C.with_spheroid_miles(df, ("lat", "lng", "other_lat", "other_lng"), "miles").withColumn("plain", C.spheroid_miles(*[F.col(c) for c in df.columns]))
    assert all((r.miles is None) == (r.plain is None) and (r.miles is None or abs(r.miles - r.plain) < 1e-9) for r in both.collect())
    others = df.select("other_lat", "other_lng")
    assert "lambda" not in plan_of(geo.within_spheroid(df.select("lat", "lng"), others, 50.0))


def test_sections_of_whole_files_move_no_lines(spark):
    text = "Fuel Card Transactions\nTransactions for Card # 12\nx,1\n\nTransactions for Card # 13\n,,sub\ny,\"2,3\"\nExpress Codes\n" + ", ".join(invoices.EXPRESS_WIDE) + "\n2024-01-01,9\ndate, no header\nz"
    parts = invoices.sections(spark.createDataFrame([("a", text), ("b", "lost\n" + text), ("c", "")], "file string, content string"))
    plan = plan_of(parts)
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    rows = {f: [tuple(r) for r in parts.where(F.col("file") == f).orderBy("line_number").select("line_number", "section", "card", "wide", "kind", F.size("fields")).collect()] for f in "abc"}
    assert rows["a"] == [
        (2, "fuel", None, None, "title", 1), (3, "fuel", "12", None, "card", 1), (4, "fuel", "12", None, "row", 2), (5, "fuel", "13", None, "card", 1), (6, "fuel", "13", None, "subtotal", 2), (7, "fuel", "13", None, "row", 2),
        (8, "express", "13", None, "title", 1), (9, "express", "13", True, "header", 14), (10, "express", "13", True, "row", 2), (11, "express", "13", True, "row", 2), (12, "express", "13", True, "row", 1),
    ]
    assert rows["b"] == [(2, None, None, None, "unexpected", 1), *((n + 1, *r) for n, *r in rows["a"])] and rows["c"] == []
