"""Incremental re-resolution against a full rebuild."""

import os
import random
from datetime import date, datetime, timedelta

from tankline.operators import anomalies, reresolution

STOP = "stop_id long, card_id long, driver_id long, truck_id long, unit_raw string, driver_raw string, station_id long, occurred_at timestamp, day date, week_end date, currency string"


def files(folder):
    return {os.path.join(d, x) for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}


def test_touched_weeks_alone_are_rebuilt(spark, tmp_path):
    rng = random.Random(3)
    rows, lines = [], []
    for n in range(300):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(70), hours=rng.randrange(24))
        driver = rng.choice([None, 1, 2, 3])
        rows.append((n, driver or 9, driver, None, rng.choice(["11", "12", " ", "31"]), "x", rng.randrange(4), at, at.date(), at.date() + timedelta(days=6 - at.weekday()), "USD"))
        lines.append((n, rng.choice(["TA", "DF", "S"]), rng.randrange(1, 9000), rng.randrange(1, 9999), rng.randrange(30_000, 50_000)))
    stops, lines = spark.createDataFrame(rows, STOP), spark.createDataFrame(lines, "stop_id long, product string, qty_c long, amount_c long, billed_t long")
    prices = spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(d), 35_000) for s in range(4) for d in range(70)], "station_id long, valid_on date, price_t long")
    kind = "driver_id long, truck_id long, valid_from date, valid_to date"
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    before = spark.createDataFrame([(1, 11, day(0), day(30)), (1, 12, day(31), None), (2, 12, day(0), None), (3, 31, day(10), None)], kind)
    after = spark.createDataFrame([(1, 11, day(0), day(37)), (1, 12, day(38), None), (2, 12, day(0), None), (3, 31, day(10), None)], kind)
    folder = str(tmp_path / "kept")
    reresolution.build(stops, lines, prices, before, folder)
    was = files(folder)
    moves, flags = reresolution.preview(folder, lines, prices, before, after)
    shown = sorted(map(tuple, moves.collect())), sorted(map(tuple, flags.collect()))
    assert files(folder) == was and shown[0] and {f[2] for f in shown[1]} >= {"cleared", "appeared"}
    made = reresolution.reresolve(folder, lines, prices, before, after, str(tmp_path / "report"))
    assert tuple(sorted(map(tuple, x.collect())) for x in made) == shown
    # the days 31 to 37 lie in two weeks; no other week has a new file
    fresh = {os.path.basename(os.path.dirname(f)).split("=")[1] for f in files(folder) - was}
    assert fresh == {str(w) for w in {r[9] for r in rows if r[2] == 1 and day(31) <= r[8] <= day(37)}} and len(fresh) <= 2
    now, found = reresolution.stored(spark, folder)
    everything = reresolution.resolved(stops, after)
    full = anomalies.run(everything, lines, prices)
    columns = ["rule", "subject_id", "severity", "detail"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, full.select(columns).collect()))
    assert sorted(map(str, now.select("stop_id", "truck_id").collect())) == sorted(map(str, everything.select("stop_id", "truck_id").collect()))
    again = reresolution.reresolve(folder, lines, prices, after, after, str(tmp_path / "again"))
    assert all(x.isEmpty() for x in again)


def test_batch_misses(spark):
    """A card off the roster is no truck's miss, a blank unit none at all, a stop without a station a miss of null."""
    from tankline.operators import joins

    stops = spark.createDataFrame([(1, 7, 100), (1, 8, None), (2, 7, None), (2, None, None), (9, 7, None)], "card_id long, station_id long, truck_id long")
    express = spark.createDataFrame([("12",), (" 12 ",), ("99",), ("99",), (" ",), (None,)], "unit_raw string")
    known = [spark.createDataFrame([(x,) for x in rows], kind) for rows, kind in (([1, 2], "card_id long"), (["12"], "unit string"), ([7], "station_id long"))]
    got = {(r.kind, r.miss): r.n for r in joins.batch_misses(stops, express, *known).collect()}
    assert got == {("card", "9"): 1, ("truck", "1"): 1, ("truck", "2"): 2, ("station", "8"): 1, ("station", None): 1, ("unit", "99"): 2}
