"""As-of joins, gaps, matching, legs, receipt checks and ordered streams against plain Python."""

import random
import time
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tankline.operators import joins, lanes, sets
from tankline.streaming import ordered, receipts

D0, T0 = date(2024, 1, 1), datetime(2024, 1, 1)


def histories(rng, keys, n):
    """Ranges of each key that don't overlap, some adjacent, the last one open."""
    out = []
    for k in range(keys):
        at = rng.randrange(5)
        for i in range(n):
            end = at + rng.randrange(4)
            out.append((k, 100 * k + i, D0 + timedelta(at), None if i == n - 1 and k % 2 else D0 + timedelta(end)))
            at = end + 1 + rng.choice([0, 0, 2])
    return out


def test_as_of_join_is_the_range_join(spark):
    rng = random.Random(4)
    kind = "driver_id long, truck_id long, valid_from date, valid_to date"
    ranges = spark.createDataFrame([*histories(rng, 6, 12), (3, 999, D0 + timedelta(900), D0 + timedelta(899)), (None, 5, D0, None)], kind)
    facts = spark.createDataFrame([(i, rng.choice([None, *range(8)]), rng.choice([None, *(D0 + timedelta(d) for d in range(-3, 60))])) for i in range(500)], "stop_id long, driver_id long, day date")
    facts = facts.unionByName(facts.limit(20))
    both = [joins.effective_dated(facts, ranges, "driver_id", overlapping=o).select("stop_id", "driver_id", "day", "truck_id", "valid_from", "valid_to").collect() for o in (False, True)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and any(r.truck_id is not None for r in both[0])
    assert joins.effective_dated(facts.limit(0), ranges, "driver_id").count() == 0
    assert joins.effective_dated(facts, ranges.limit(0), "driver_id").where("truck_id is not null").isEmpty()


def test_as_of_join_refuses_overlaps(spark):
    ranges = spark.createDataFrame([(1, 7, D0, None), (1, 8, D0 + timedelta(3), None)], "driver_id long, truck_id long, valid_from date, valid_to date")
    facts = spark.createDataFrame([(1, 1, D0 + timedelta(5))], "stop_id long, driver_id long, day date")
    with pytest.raises(Exception, match="overlap"):
        joins.effective_dated(facts, ranges, "driver_id").collect()
    assert joins.effective_dated(facts, ranges, "driver_id", overlapping=True).count() == 2


def test_as_of_join_of_one_hot_key(spark):
    """Ten thousand ranges and a hundred thousand facts of one key: their sum, where the range join would look at a thousand million pairs."""
    day = lambda c: F.date_add(F.lit("1900-01-01").cast("date"), c.cast("int"))
    ranges = spark.range(10_000).select(F.lit(1).cast("long").alias("driver_id"), F.col("id").alias("truck_id"), day(F.col("id") * 3).alias("valid_from"), day(F.col("id") * 3 + 1).alias("valid_to"))
    facts = spark.range(100_000).select(F.col("id").alias("stop_id"), F.lit(1).cast("long").alias("driver_id"), day(F.col("id") % 30_000).alias("day"))
    found = joins.effective_dated(facts, ranges, "driver_id").withColumn("d", F.col("stop_id") % 30_000)
    bad = found.where(~F.col("truck_id").eqNullSafe(F.when(F.col("d") % 3 < 2, F.floor(F.col("d") / 3))))
    assert found.count() == 100_000 and bad.isEmpty()


def test_gaps_against_days(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), D0 + timedelta(a), D0 + timedelta(a + rng.randrange(-1, 9))) for a in (rng.randrange(200) for _ in range(60))]
    ranges = spark.createDataFrame(rows + rows[:5], "truck_id long, start_day date, end_day date")
    wanted = set()
    for k in (None, 1, 2):
        own = {a + timedelta(i) for p, a, b in rows if p == k for i in range((b - a).days + 1)}
        wanted |= {(k, min(own) + timedelta(i)) for i in range((max(own) - min(own)).days)} - {(k, d) for d in own}
    assert {tuple(r) for r in sets.coverage_gaps(ranges, "truck_id").collect()} == wanted
    gaps = sets.gap_ranges(ranges, "truck_id").collect()
    assert sum((r.to_day - r.from_day).days + 1 for r in gaps) == len(wanted) > len(gaps)


def plain_consume(plans, fills):
    taken, out = set(), []
    for at, i in sorted((m, p) for p, m in plans):
        free = [(abs(m - at), m, s) for s, m in fills if s not in taken]
        if free:
            taken.add(min(free)[2])
            out.append((i, min(free)[2]))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_nearest_free_fill(seed):
    rng = random.Random(seed)
    most = rng.choice([3, 20, 1000])
    plans, fills = ([(i, rng.randrange(most)) for i in range(rng.randrange(1, 30))] for _ in range(2))
    frames = [pd.DataFrame(sorted(x, key=lambda r: (r[1], r[0])), columns=[name, "micros"]) for x, name in ((plans, "plan_stop_id"), (fills, "stop_id"))]
    assert joins.consume(*frames) == plain_consume(plans, fills)


def test_nearest_free_fill_of_one_hot_key():
    rng = random.Random(1)
    frames = [pd.DataFrame({name: range(20_000), "micros": sorted(rng.randrange(10**9) for _ in range(20_000))}) for name in ("plan_stop_id", "stop_id")]
    begin = time.monotonic()
    found = joins.consume(*frames)
    assert len({s for _, s in found}) == 20_000 and time.monotonic() - begin < 5


def test_legs_of_bins_are_all_legal_legs(spark):
    rng = random.Random(6)
    kind = "lane_id long, distance double, mpg double, max_leg double, min_leg double, within_leg boolean"
    table = [(1, 1000.0, 5.0, 100.0, 20.0, True), (2, 1000.0, 5.0, 100.0, 0.0, False), (3, 80.0, 5.0, 100.0, 50.0, True)]
    spots = [(lane, s, float(min(d, rng.choice([0, 100, 200, rng.randrange(int(d))])))) for lane, d, *_ in table for s in range(40)]
    got = sorted(tuple(r) for r in lanes.leg_graph(spark.createDataFrame(table, kind), spark.createDataFrame(spots, "lane_id long, station_id long, mile double")).select("lane_id", "from_node", "to_node", "is_end").collect())
    wanted = []
    for lane, distance, _, cap, floor, within in table:
        nodes = [0.0, *(m for m, _ in sorted((m, s) for k, s, m in spots if k == lane)), distance]
        for i, a in enumerate(nodes[:-1]):
            for j in range(i + 1, len(nodes)):
                end, miles = j == len(nodes) - 1, nodes[j] - a
                if (not within or miles <= cap + 1e-6) if end else floor - 1e-6 <= miles <= cap + 1e-6:
                    wanted.append((lane, i, j, end))
    assert got == sorted(wanted)


def test_pairs_of_a_lane_grow_with_its_nodes(spark):
    """Ten times the nodes on ten times the miles: ten times the legs that the join looks at, not a hundred times."""
    one = "SELECT 1L AS lane_id, {d}D AS distance, 5D AS mpg, 100D AS max_leg, 0D AS min_leg, true AS within_leg"
    counts = []
    for n in (200, 2000):
        spots = spark.range(n).select(F.lit(1).cast("long").alias("lane_id"), F.col("id").alias("station_id"), (F.col("id") * 10.0).alias("mile"))
        counts.append(lanes.leg_graph(spark.sql(one.format(d=n * 10)), spots).count())
    assert 9 < counts[1] / counts[0] < 11


# receipt checks


def plain_checks(requests, stops):
    status, out = {s: x for s, _, x in stops}, []
    for q in sorted(requests, key=lambda q: (q[1], q[0])):
        number, at, kind, stop, driver, outcome, by = q
        of = [stop] if kind != "confirm_driver" else [s for s, d, _ in stops if d is not None and d == driver]
        for s in of:
            if s in status and (kind == "decide" or status[s] != "confirmed"):
                status[s] = outcome if kind == "decide" else "confirmed"
                out.append((s, number, status[s], by))
    return sorted(out), status


REQUEST = "request_id long, asked_at timestamp, kind string, stop_id long, driver_id long, outcome string, checked_by long"


def requests_of(rng, n, first=0):
    out = []
    for i in range(first, first + n):
        kind = rng.choice(["decide", "confirm", "confirm_driver", "decide"])
        stop, driver = (None, rng.choice([0, 1, 2, None])) if kind == "confirm_driver" else (rng.choice([0, 1, 2, 3, 4, 5, 6, 99]), None)
        out.append((i, T0 + timedelta(minutes=first + rng.randrange(n)), kind, stop, driver, rng.choice(["confirmed", "missing", "pending"]) if kind == "decide" else None, rng.randrange(3)))
    return out


STOPS = [(0, 0, "pending"), (1, 0, "confirmed"), (2, 1, "missing"), (3, 1, "pending"), (4, 2, "pending"), (5, None, "pending"), (6, 2, "confirmed")]


@pytest.mark.parametrize("seed", range(4))
def test_effects_of_a_batch_are_those_of_one_request_after_the_other(spark, seed):
    requests = requests_of(random.Random(seed), 60)
    stops = spark.createDataFrame(STOPS, "stop_id long, driver_id long, status string")
    made = receipts.effects(spark.createDataFrame(requests, REQUEST), stops)
    checks, status = plain_checks(requests, STOPS)
    assert sorted((r.stop_id, r.request_id, r.outcome, r.checked_by) for r in made.collect()) == checks
    assert {r.stop_id: r.status for r in receipts.statuses(stops, made).collect()} == status


def test_sink_takes_each_batch_once(spark, tmp_path):
    """Three parts arrive; the job is lost between the writes of the second, starts again, and all parts are delivered once more."""
    rng = random.Random(11)
    parts = [requests_of(rng, 25, 100 * k) for k in range(3)]
    stops = spark.createDataFrame(STOPS, "stop_id long, driver_id long, status string")
    sink, seen = f"file://{tmp_path}/sink", []

    def between(batch):
        seen.append(batch)
        if seen == [0, 1]:
            # what was written is not entered, so nobody sees it
            assert receipts.checks(spark, sink).count() == len(plain_checks(parts[0], STOPS)[0])
            raise RuntimeError("lost")

    stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in/part=*")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, REQUEST).write.parquet(f"{tmp_path}/in/part={k}")
        run = lambda: receipts.feed(stream, stops, sink, f"{tmp_path}/state", between).awaitTermination()
        if k == 1:
            with pytest.raises(StreamingQueryException):
                run()
        run()
    assert seen == [0, 1, 1, 2]
    assert not any(receipts.deliver(spark.createDataFrame(rows, REQUEST), k, stops, sink) for k, rows in enumerate(parts))
    checks, status = plain_checks([q for rows in parts for q in rows], STOPS)
    found = receipts.checks(spark, sink)
    assert sorted((r.stop_id, r.request_id, r.outcome, r.checked_by) for r in found.collect()) == checks
    assert {r.stop_id: r.status for r in receipts.statuses(stops, found).collect()} == status
    people = spark.createDataFrame([(0, "Ann"), (1, "Bo")], "driver_id long, driver_name string")
    at = {q[0]: q[1] for rows in parts for q in rows}
    last = {s: (n, by) for s, n, _, by in sorted(checks, key=lambda c: (at[c[1]], c[1]))}
    names = {r.stop_id: r.checker for r in receipts.latest_check(found, people).collect()}
    assert names == {s: {0: "Ann", 1: "Bo"}.get(by) for s, (_, by) in last.items()}


# ordered streams


@pytest.mark.parametrize("kind", ["neighbours", "lives"])
def test_streams_in_any_order(spark, tmp_path, kind):
    rng = random.Random(13)
    rows = [(i, rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(3000))) for i in range(150)]
    rng.shuffle(rows)
    stream = spark.readStream.schema("event_id long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n=*")
    make = {
        "neighbours": lambda s: ordered.neighbours(s, ["kind"], "at", "event_id", 30, "4 days"),
        "lives": lambda s: ordered.lives(s, ["kind"], "at", "event_id", 500 * 60, "4 days"),
    }[kind]
    end = [(-1, "z", T0 + timedelta(days=400))]
    for k, part in enumerate([rows[:60], rows[60:110], rows[110:], end]):
        spark.createDataFrame(part, "event_id long, kind string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/n={k}")
        # stopped and started again after each part
        make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.schema(make(stream).schema).parquet(f"{tmp_path}/out").collect()
    wanted = []
    for key in "ab":
        own = sorted((t, i) for i, k, t in rows if k == key)
        if kind == "neighbours":
            wanted += [(key, i, j, int((t - u).total_seconds())) for (u, j), (t, i) in zip(own, own[1:], strict=False) if t - u <= timedelta(minutes=30)]
        else:
            begin = None
            for t, i in own:
                if begin is None or t >= begin + timedelta(minutes=500):
                    wanted.append((key, i))
                    begin = t
    got = sorted(tuple(r) if kind == "neighbours" else (r.kind, r.event_id) for r in found)
    assert got == sorted(wanted) and len(got) > 8


def test_sheets_in_any_order_and_again(spark, tmp_path):
    """Sheets of different days, dropped in two orders with repeats under other names, the second drop lost before its entry once."""
    from pyspark.sql.types import StringType, StructField, StructType

    from tankline.sources import price_sheets
    from tankline.streaming import drops

    def sheet(day, prices):
        rows = "\n".join(f"{site},Stop,AUSTIN,TX,TA,{p},0,0,0,0,0,{p},{p},{p},0" for site, p in prices)
        return f'"Effective Date: ",2024-01-{day:02d}\n{",".join(price_sheets.HEADER)}\n{rows}\n'

    texts = {f"s{d}.csv": sheet(d, [(s, f"{3 + d / 10:.4f}") for s in range(3)]) for d in (1, 2, 3, 4)}
    kind = StructType([StructField("file", StringType()), StructField("content", StringType())])
    products = spark.createDataFrame([("TA", "highway_diesel")], "raw_code string, product_type string")
    found = []
    for k, order in enumerate([[["s1.csv", "s3.csv"], ["s4.csv", "s1.csv"], ["s2.csv"]], [["s4.csv"], ["s2.csv", "s3.csv", "s4.csv"], ["s1.csv"], ["s2.csv"]]]):
        folder = f"file://{tmp_path}/sink{k}"
        drops.create(spark, folder)
        for n, names in enumerate(order):
            batch = spark.createDataFrame([(f"{n}-{x}", texts[x]) for x in names], kind)
            if n == 1:
                with pytest.raises(ZeroDivisionError):
                    drops.deliver(batch, n, products, folder, lambda b: 1 // 0)
            assert drops.deliver(batch, n, products, folder) and not drops.deliver(batch, n, products, folder)
        rows = drops.stored(spark, folder, "prices").collect()
        found.append(sorted((r.site, r.prod, r.valid_on, r.price) for r in rows))
        assert drops.stored(spark, folder, "hashes").count() == 4
    assert found[0] == found[1] and len(found[0]) == 12 and {r[2].day for r in found[0]} == {1, 2, 3, 4}
