"""Scalar functions and small operators on literal rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tankline.functions import exprs as C
from tankline.operators import aggregates, anomalies, geo, joins, lanes, windows
from tankline.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("SAN ANTONIO", "San Antonio"), ("TRUTH OR CONSEQUENCES", "Truth or Consequences"), ("MT VERNON", "Mount Vernon"), ("ST LOUIS", "St. Louis"), ("N LITTLE ROCK", "North Little Rock"), ("McAllen", "McAllen"), ("MC DONOUGH", "McDonough"), ("New York", "New York"), ("OF MICE", "Of Mice")],
)
def test_city(spark, raw, wanted):
    assert one(spark, C.normalize_city(F.col("x")), x=raw) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("O'NEIL, JOHN-PAUL", "Oneil John Paul"), ("  ", None), ("MC DONALD RON", "McDonald Ron")])
def test_name(spark, raw, wanted):
    assert one(spark, C.normalize_name(F.col("x")), x=raw) == wanted


def test_rounding_and_money(spark):
    assert one(spark, C.half_up(F.col("x")), x=-2.5) == -2
    assert one(spark, C.convert_cents(F.lit(1000), F.lit("USD"), "CAD", F.lit(1365500))) == 1366
    assert one(spark, C.convert_cents(F.lit(-1001), F.lit("USD"), "CAD", F.lit(1500000))) == -1502
    assert one(spark, C.convert_cents(F.lit(5), F.lit("USD"), "CAD", F.lit(None))) is None
    got = [one(spark, C.decimal_text(F.col("x"), 2), x=v) for v in ("1.25", "1.255", "1e3", "-0.00", "+1")]
    assert [None if v is None else float(v) for v in got] == [1.25, None, None, 0.0, None]
    assert str(one(spark, C.decimal_text(F.col("x"), 2), x="-3.5")) == "-3.50"


def test_polyline():
    assert geo.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert geo.decode_polyline("_p~iF~ps|") is None and geo.decode_polyline("") == []


def test_polyline_job(spark):
    rows = geo.decode_polylines(spark.createDataFrame([(1, "_p~iF~ps|U"), (2, "_p~iF"), (3, None)], "lane long, line string"), "lane", "line").collect()
    assert sorted((r.lane, r.seq, r.error) for r in rows if r.lane != 2) == [(1, 0, None)] and [r.error for r in rows if r.lane == 2] == ["truncated"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("123 Main Street, Springfield, Illinois 62701-1234", "123 main st springfield il 62701"), ("123 MAIN ST SPRINGFIELD IL 62701", "123 main st springfield il 62701"), ("9 North Oak Ave. Apt #4", "9 n oak ave ste ste 4"),
        ("Unit 4, 5 Elm Circle, North Carolina", "ste 4 5 elm cir nc"), ("St Louis, MO", "st louis mo"), ("Saint Louis, MO", "saint louis mo"), ("West Virginia", "wv"), ("\uff11\uff12 Oak\u00a0Terrace", "12 oak ter"), (" , ", ""), ("1 Route 66; Bldg-2", "1 route 66; bldg-2"),
    ],
)
def test_address(spark, raw, wanted):
    assert one(spark, C.normalize_address(F.col("x")), x=raw) == wanted


def test_maps_link_keeps_all_way_points(spark):
    link = one(spark, C.maps_link(F.lit("1.5,-2"), F.lit("3,4"), F.array(F.lit("5,6"), F.lit("7,8"))))
    assert link == "https://www.google.com/maps/dir/?api=1&origin=1.5%2C-2&destination=3%2C4&waypoints=5%2C6%7C7%2C8&travelmode=driving"
    with pytest.raises(Exception, match="9 way points, not 10"):
        one(spark, C.maps_link(F.lit("a"), F.lit("b"), F.array(*[F.lit("5,6")] * 10)))


def test_savings_are_of_fuel_against_all_candidates(spark):
    lane = spark.createDataFrame([(1, 500.0, 5.0, 0.5)], "lane_id long, distance double, mpg double, cost_mile double")
    cand = spark.createDataFrame([(1, 7, 3.0, 2.0), (1, 8, 5.0, 0.0)], "lane_id long, station_id long, price double, detour_miles double")
    plan = spark.createDataFrame([(1, "plan", 0, 7, 150.0, 190.0)], "lane_id long, status string, seq int, station_id long, fuel_cost double, total_cost double")
    r = lanes.plan_totals(plan, lane, cand).first()
    assert (r.savings, r.total_cost, r.detour_cost) == (100.0 * 4.0 - 150.0, 190.0, 1.0)


def test_points_near_the_poles_and_across_the_date_line(spark):
    a = spark.createDataFrame([(1, 89.9, 0.0), (2, 10.0, 179.95), (3, 75.0, 10.0)], "id long, lat double, lng double")
    b = spark.createDataFrame([(11, 89.9, 180.0), (12, 10.0, -179.95), (13, 75.0, 11.0), (14, 75.0, 13.0)], "other long, other_lat double, other_lng double")
    assert {(r.id, r.other) for r in geo.within(a, b, 20.0).collect()} == {(1, 11), (2, 12), (3, 13)}


def test_corridor_exclusions(spark):
    route = spark.createDataFrame([(1, 0, 40.0, -100.0), (1, 1, 40.0, -90.0)], "lane_id long, seq int, lat double, lng double")
    own = spark.createDataFrame([(1, 500.0, 5.0, date(2025, 1, 1))], "lane_id long, distance double, corridor double, day date")
    kind = "station_id long, lat double, lng double, country string, resolution string, truck_accessible string, uncertainty double"
    rows = [(1, 40.0, -95.0, "US", "exact", "x", 0.0), (2, 40.1, -94.0, "US", "city", "x", 0.0), (3, 40.1, -93.0, "US", "city", "x", 3.0), (4, 40.0, -92.0, "US", "unresolved", "x", 0.0), (5, 40.0, -92.0, "CA", "exact", "x", 0.0), (6, 40.0, -91.0, "US", "exact", "excluded", 0.0), (7, 40.0, -98.0, "US", "exact", "x", None)]
    prices = spark.createDataFrame([(1, date(2025, 1, 1), 9, 3.5), (1, date(2025, 1, 1), 10, 3.1), (3, date(2025, 1, 1), 1, None), (7, date(2025, 1, 2), 1, 3.0)], "station_id long, valid_on date, price_id long, your_price double")
    got = {r.station_id: (r.price, r.excluded, round(r.mile)) for r in lanes.corridor_candidates(route, own, spark.createDataFrame(rows, kind), prices).collect()}
    assert got == {1: (3.5, None, 250), 3: (None, "price_basis_null", 350), 7: (None, "no_price_on_date", 100)}


def test_stream_counts_hold_open_days(spark, tmp_path):
    for name, hours in (("a", [1, 2]), ("b", [3, 30])):
        spark.createDataFrame([(datetime(2025, 1, 1) + timedelta(hours=h), "x") for h in hours], "at timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_to_counts(jobs.daily_calls(events, "at", ["kind"]), ["day", "kind"], "calls")
    assert {(r.day, r.calls) for r in got.collect()} == {(date(2025, 1, 1), 3), (date(2025, 1, 2), 1)}


def test_first_within_forgets_after_its_time(spark, tmp_path):
    """A key is new again in the batches after the one in which the watermark has passed its time to live."""
    start = datetime(2025, 1, 1)
    for k, rows in enumerate([[("a", 0), ("a", 1)], [("b", 100)], [("b", 102)], [("a", 101), ("b", 103)]]):
        table = spark.createDataFrame([(key, start + timedelta(days=d)) for key, d in rows], "kind string, at timestamp").coalesce(1)
        table.write.mode("append").parquet(str(tmp_path / "in" / f"n={k}"))
    events = spark.readStream.schema("kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    got = sorted((r.kind, (r["at"] - start).days) for r in jobs.run_to_table(jobs.first_within(events, ["kind"], "at", "30 days")).collect())
    assert got == [("a", 0), ("a", 101), ("b", 100)]


def test_plan_actual_consumes_once(spark):
    t = lambda h: datetime(2025, 1, 1, h)
    day = date(2025, 1, 1)
    planned = spark.createDataFrame([(1, day, 9, 100, t(8)), (1, day, 9, 101, t(9)), (2, day, 9, 102, t(8))], "truck_id long, day date, station_id long, plan_stop_id long, dispatched_at timestamp")
    actual = spark.createDataFrame([(1, day, 9, 500, t(9)), (1, day, 9, 501, t(20)), (3, day, 9, 502, t(1)), (1, day, None, 503, t(1))], "truck_id long, day date, station_id long, stop_id long, occurred_at timestamp").withColumn("split_fill", F.col("stop_id") == 504)
    assert joins.match_exclusions(actual).first() == (0, 1)
    got = {(r.plan_stop_id, r.stop_id, r.kind) for r in joins.plan_actual(planned, actual).collect()}
    assert got == {(100, 500, "matched"), (101, 501, "matched"), (102, None, "skipped_recommendation"), (None, 502, "unplanned_stop")}


def test_corridor_finds_stations_beside_long_segments(spark):
    route = spark.createDataFrame([(1, 0, 40.0, -100.0), (1, 1, 40.0, -90.0)], "lane long, seq int, lat double, lng double")
    spots = spark.createDataFrame([(1, 40.1, -95.0), (2, 41.5, -95.0), (3, 39.9, -90.05)], "station_id long, other_lat double, other_lng double")
    got = {r.station_id: (round(r.fraction, 3), r.perp_miles) for r in geo.corridor(route, spots, "lane", "seq", 10.0).collect()}
    assert set(got) == {1, 3} and got[1][0] == 0.5 and 6.5 < got[1][1] < 7.2 and got[3][0] == 0.995


def test_distance_to_nowhere_is_unknown(spark):
    assert spark.range(1).select(C.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("d")).first().d is None


def test_missing_threshold_is_an_error(spark):
    with pytest.raises(ValueError, match="too_close"):
        anomalies.load_thresholds(spark.createDataFrame([(r, "{}") for r in anomalies.RULES if r != "too_close"], "rule string, settings string"))


def test_empty_inputs(spark):
    stops = spark.createDataFrame([], "stop_id long, driver_id long, total_c long, status string")
    lines = spark.createDataFrame([], "stop_id long, product string, qty_c long, billed_t long")
    assert aggregates.finish_rollup(aggregates.rollup(stops, lines, "driver_id")).count() == 0


def test_reprojection(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 50.0, None), (1, 100.0, 120.0)], "lane long, old double, anchor double")
    assert [r.moved for r in windows.reproject(rows, "lane", "old", "old", "anchor").orderBy("old").collect()] == [0.0, 60.0, 120.0]


def test_file_drops_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,1\n")
    seen = []
    for _ in range(2):
        jobs.ingest_files(spark, str(tmp_path / "in"), lambda b: seen.extend(r.content for r in b.collect()), str(tmp_path / "state")).awaitTermination()
    assert seen == ["x,1\n"]


def test_spheroid_miles_of_published_pairs(spark):
    """Flinders Peak to Buninyong, an Atlantic crossing, a quarter meridian, degrees of the equator: to a millimetre."""
    dms = lambda d, m, s: (d + m / 60 + s / 3600)
    pairs = [
        (-dms(37, 57, 3.7203), dms(144, 25, 29.5244), -dms(37, 39, 10.1561), dms(143, 55, 35.3839), 54972.271), (40.6, -73.8, 51.6, -0.5, 5551759.400), (0.0, 0.0, 90.0, 0.0, 10001965.729),
        (0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 179.5, 0.0, -179.5, 111319.491), (10.0, 10.0, 10.0, 10.0, 0.0),
    ]
    a, b, c, d = (F.col(x) for x in "abcd")
    got = spark.createDataFrame(pairs, "a double, b double, c double, d double, metres double").select((C.spheroid_miles(a, b, c, d) * C.METERS_PER_MILE).alias("m"), "metres").collect()
    assert all(abs(r.m - r.metres) < 1e-3 for r in got)
    assert spark.range(1).select(C.spheroid_miles(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("d")).first().d is None


def test_spheroid_joins(spark):
    """A pair that the sphere puts within the radius and the spheroid doesn't, one the other way round; a slanted route's nearest point."""
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, -100.0)], "id long, lat double, lng double")
    b = spark.createDataFrame([(11, 0.0, 1.0), (12, 41.0, -100.0)], "other long, other_lat double, other_lng double")
    on_sphere = {r.id: r.miles for r in geo.within(a, b, 80.0).collect()}
    on_spheroid = {r.id: r.miles for r in geo.within_spheroid(a, b, 80.0).collect()}
    assert on_spheroid[1] > on_sphere[1] and on_spheroid[2] < on_sphere[2]
    for own, radius in ((1, on_sphere[1] + 0.01), (2, on_spheroid[2] + 0.01)):
        only = a.where(f"id = {own}")
        assert (geo.within(only, b, radius).count(), geo.within_spheroid(only, b, radius).count()) == ((1, 0) if own == 1 else (0, 1))
    route = spark.createDataFrame([(1, 0, 49.0, -100.0), (1, 1, 49.2, -99.8)], "lane long, seq int, lat double, lng double")
    spots = spark.createDataFrame([(5, 49.2, -100.0)], "station_id long, other_lat double, other_lng double")
    got = geo.corridor(route, spots, "lane", "seq", 15.0, on_spheroid=True).first()
    rows = spark.range(20001).select((F.col("id") / 20000.0).alias("t"))
    least = rows.select(F.min(C.spheroid_miles(F.lit(49.2), F.lit(-100.0), 49.0 + 0.2 * F.col("t"), -100.0 + 0.2 * F.col("t"))).alias("m")).first().m
    assert abs(got.perp_miles - least) < 1e-4 and abs(got.fraction - 0.5) < 1e-9
    assert geo.corridor(route, spots, "lane", "seq", 15.0).first().perp_miles > got.perp_miles
