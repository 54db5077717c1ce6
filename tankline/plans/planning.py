"""Registered queries: spatial joins and lane jobs over lanes and candidates derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions.exprs import haversine, spheroid_miles
from tankline.operators import aggregates as A
from tankline.operators import geo, joins, lanes, windows
from tankline.plans.registry import query

# A lane is a part brand and size; its candidates are the suppliers of its parts, at a mile and price from their keys.
CANDIDATES = """SELECT CAST(REPLACE(p_brand, 'Brand#', '') AS BIGINT) * 100 + p_size AS lane_id, l_suppkey AS station_id, MIN(l_orderkey * 37 % 1200 + 20) AS mile_i, MIN(CAST(FLOOR(l_extendedprice / l_quantity + 0.5) AS BIGINT)) AS price_i, l_suppkey % 7 AS detour_i
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 5"""


def candidates(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    lane = F.regexp_replace("p_brand", "Brand#", "").cast("bigint") * 100 + F.col("p_size")
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        lane.alias("lane_id"), F.col("l_suppkey").alias("station_id"), (F.col("l_orderkey") * 37 % 1200 + 20).alias("mile_i"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("bigint").alias("price_i")
    )
    return rows.groupBy("lane_id", "station_id").agg(F.min("mile_i").alias("mile_i"), F.min("price_i").alias("price_i")).withColumn("detour_i", F.col("station_id") % 7)


def lane_table(cand: DataFrame) -> DataFrame:
    """A truck of 150 gallons at 5 mpg on a lane of 1,250 miles."""
    fixed = {"distance": 1250.0, "tank": 150.0, "mpg": 5.0, "reserve": 0.2, "max_leg": 500.0, "min_leg": 300.0, "start": 150.0, "min_arrival": 30.0, "cost_mile": 0.5, "cost_hour": 0.0, "stop_minutes": 0.0}
    out = cand.select("lane_id").distinct().withColumns({k: F.lit(v) for k, v in fixed.items()})
    return out.withColumn("within_leg", F.lit(True)).withColumn("max_stops", F.when(F.col("lane_id") % 3 == 0, 3.0))


def priced(cand: DataFrame) -> DataFrame:
    return cand.select("lane_id", "station_id", F.col("mile_i").cast("double").alias("mile"), (F.col("price_i") / 1000.0).alias("price"), (F.col("detour_i") / 10.0).alias("detour_miles"), F.lit(0.0).alias("detour_hours"))


@query(
    "R3_leg_graph", "lineitem part",
    f"""WITH c AS ({CANDIDATES}), nd AS (SELECT lane_id, CAST(mile_i AS DOUBLE) AS mile, CAST(ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY mile_i, station_id) AS INT) AS node FROM c), e AS (SELECT lane_id, 1250.0::DOUBLE AS mile, MAX(node)+1 AS node FROM nd GROUP BY 1),
    a AS (SELECT lane_id, mile, node FROM nd UNION ALL SELECT DISTINCT lane_id, 0.0::DOUBLE, 0 FROM nd), b AS (SELECT lane_id, mile, node, FALSE AS is_end FROM nd UNION ALL SELECT lane_id, mile, node, TRUE FROM e)
    SELECT a.lane_id, a.node AS from_node, b.node AS to_node, b.mile-a.mile AS miles, CAST(GREATEST(0, CEIL((b.mile-a.mile)/5.0/2.0-1e-9)) AS INT) AS burn_levels, is_end FROM a JOIN b ON a.lane_id=b.lane_id AND b.node>a.node
    WHERE b.mile-a.mile<=500.000001 AND (is_end OR b.mile-a.mile>=299.999999)""",
)
def leg_graph(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.leg_graph(lane_table(cand), priced(cand))


def chosen(cand: DataFrame) -> DataFrame:
    """R2: the candidates that a lane is solved with, spread over its length; so a lane stays a small group."""
    return priced(windows.stratified_top(cand, "lane_id", "mile_i", "price_i", "station_id", k=40))


@query(
    "R4_fewest_stops", "lineitem part",
    f"""WITH RECURSIVE c AS ({CANDIDATES}), b AS (SELECT lane_id, station_id, mile_i, price_i, mile_i//50 AS bucket FROM c), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lane_id, bucket ORDER BY price_i, mile_i, station_id) AS round FROM b),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY round, price_i, mile_i, station_id) AS place, COUNT(*) FILTER (round=1) OVER (PARTITION BY lane_id) AS occ FROM r), n AS (SELECT DISTINCT lane_id, mile_i FROM p WHERE place<=GREATEST(40, occ)),
    reached AS (SELECT DISTINCT lane_id, CAST(0 AS BIGINT) AS mile_i, 0 AS stops FROM c UNION SELECT n.lane_id, n.mile_i, stops+1 FROM reached JOIN n ON n.lane_id=reached.lane_id AND n.mile_i-reached.mile_i BETWEEN 300 AND 500),
    f AS (SELECT lane_id, CAST(MIN(stops) FILTER (1250-mile_i<=500) AS INT) AS min_stops FROM reached GROUP BY 1)
    SELECT lane_id, min_stops, CASE WHEN min_stops IS NULL THEN 'LEG_GAP' WHEN lane_id % 3 = 0 AND min_stops>3 THEN 'MAX_STOPS_EXCEEDED' ELSE 'FUEL_INFEASIBLE' END AS diagnosis FROM f""",
)
def fewest(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.fewest_stops(lane_table(cand), chosen(cand))


@query("R5_exact_plans", "lineitem part", None)
def exact(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.solve(lane_table(cand), chosen(cand))


@query("R6_greedy_plans", "lineitem part", None)
def greedy(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.solve(lane_table(cand), chosen(cand), "greedy")


@query("R7_relaxed_plans", "lineitem part", None)
def relaxed(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.solve_relaxed(lane_table(cand), chosen(cand))


@query("R9_backtest", "stop line station published", None)
def backtest(stop, line, station, published):
    """Truck days of all stops; every seventh truck has no profile, and days without a published price have no sheet."""
    days = A.truck_days(stop, line).select("truck_id", "day", "stations", (F.col("cost_m") / 1e6).alias("actual_cost"))
    profile = {"tank": 150.0, "mpg": 5.0, "reserve": 0.2, "max_leg": 500.0, "min_leg": 300.0, "cost_mile": 0.5}
    trucks = stop.where("truck_id is not null").select("truck_id").distinct().withColumns({k: F.lit(v) for k, v in profile.items()}).withColumn("mpg", F.when(F.col("truck_id") % 7 != 0, F.col("mpg")))
    full, own, found = lanes.historical_lanes(days, station, published.withColumn("price", F.col("price_t") / 10000.0), trucks)
    return lanes.backtest(full.select("lane_id", "truck_id", "day", "actual_cost", "excluded"), lanes.solve_history(own, found))


@query("U9_not_selected", "lineitem part", f"""WITH c AS ({CANDIDATES}), b AS (SELECT lane_id, station_id, mile_i, price_i, CAST(mile_i//50 AS INT) AS bucket FROM c), r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane_id, bucket ORDER BY price_i, mile_i, station_id) AS INT) AS round FROM b),
    p AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY round, price_i, mile_i, station_id) AS INT) AS place, COUNT(*) FILTER (round=1) OVER (PARTITION BY lane_id) AS occ FROM r) SELECT lane_id, station_id FROM p WHERE place>GREATEST(40, occ)""")
def not_selected(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.not_selected(cand, chosen(cand)).select("lane_id", "station_id")


@query("O6_corridor_order", "lineitem part", f"WITH c AS ({CANDIDATES}) SELECT lane_id, station_id, ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY mile_i, station_id) AS place FROM c")
def corridor_order(lineitem, part):
    place = F.row_number().over(Window.partitionBy("lane_id").orderBy("mile_i", "station_id"))
    return candidates(lineitem, part).select("lane_id", "station_id", place.alias("place"))


@query("R11_plan_list", "lineitem part", None)
def plan_list(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.plan_totals(lanes.solve(lane_table(cand), chosen(cand)), lane_table(cand), priced(cand))  # the baseline is the mean of all


@query(
    "A29_baseline_cost", "lineitem part",
    f"WITH c AS ({CANDIDATES}) SELECT lane_id, ROUND(1250.0/5.0*AVG(price_i/1000.0::DOUBLE), 8) AS baseline FROM c GROUP BY 1",
)
def baseline(lineitem, part):
    cand = candidates(lineitem, part)
    return lanes.baseline_cost(lane_table(cand), priced(cand)).withColumn("baseline", F.round("baseline", 8))


@query("R2_selected_candidates", "lineitem part", f"""WITH c AS ({CANDIDATES}), b AS (SELECT lane_id, station_id, mile_i, price_i, CAST(mile_i//50 AS INT) AS bucket FROM c WHERE detour_i/10.0<=0.5), r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane_id, bucket ORDER BY price_i, mile_i, station_id) AS INT) AS round FROM b),
    p AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY round, price_i, mile_i, station_id) AS INT) AS place, COUNT(*) FILTER (round=1) OVER (PARTITION BY lane_id) AS occ FROM r) SELECT lane_id, station_id, mile_i, place FROM p WHERE place<=GREATEST(5, occ)""")
def selected(lineitem, part):
    near = candidates(lineitem, part).where(F.col("detour_i") / 10.0 <= 0.5)
    return windows.stratified_top(near, "lane_id", "mile_i", "price_i", "station_id", k=5).select("lane_id", "station_id", "mile_i", "place")


HAVERSINE = "2*3958.8*ASIN(LEAST(1.0, SQRT(POW(SIN(RADIANS({b}.lat-{a}.lat)/2),2)+COS(RADIANS({a}.lat))*COS(RADIANS({b}.lat))*POW(SIN(RADIANS({b}.lng-{a}.lng)/2),2))))"


@query("J7_within_radius", "station", f"SELECT a.station_id, b.station_id AS other_id, ROUND({HAVERSINE.format(a='a', b='b')}, 5) AS miles FROM station a JOIN station b ON {HAVERSINE.format(a='a', b='b')}<=120 WHERE a.station_id<>b.station_id")
def within(station):
    other = station.select(F.col("station_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    return geo.within(station.select("station_id", "lat", "lng"), other, 120.0).where("station_id <> other_id").select("station_id", "other_id", F.round("miles", 5).alias("miles"))


@query("J8_nearest", "station", f"WITH d AS (SELECT a.station_id, b.station_id AS other_id, {HAVERSINE.format(a='a', b='b')} AS m FROM station a JOIN station b ON a.station_id<>b.station_id) SELECT station_id, ROUND(MIN(m), 5) AS miles FROM d WHERE m<=120 GROUP BY 1")
def nearest(station):
    other = station.select(F.col("station_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    pairs = geo.within(station.select("station_id", "lat", "lng"), other, 120.0).where("station_id <> other_id")
    return geo.nearest(pairs, "station_id", "other_id").select("station_id", F.round("miles", 5).alias("miles"))


def _geodesic(rows: str, a: str, b: str, rounds: int) -> str:
    """DuckDB text: the rows of a query with their miles on the spheroid (gm) between the points `a`lat, `a`lng and `b`lat, `b`lng."""
    flat = "(1/298.257223563)"
    steps = [
        f"ATAN((1-{flat})*TAN(RADIANS({a}lat))) AS g1, ATAN((1-{flat})*TAN(RADIANS({b}lat))) AS g2, RADIANS({b}lng-{a}lng) AS gl",
        "SIN(g1) AS gs1, COS(g1) AS gc1, SIN(g2) AS gs2, COS(g2) AS gc2, gl AS x0",
    ]
    for k in range(rounds):
        steps += [
            f"SQRT(POW(gc2*SIN(x{k}),2)+POW(gc1*gs2-gs1*gc2*COS(x{k}),2)) AS ss{k}, gs1*gs2+gc1*gc2*COS(x{k}) AS cs{k}",
            f"ATAN2(ss{k},cs{k}) AS arc{k}, COALESCE(gc1*gc2*SIN(x{k})/NULLIF(ss{k},0),0) AS sa{k}", f"1-sa{k}*sa{k} AS ca{k}",
            f"COALESCE(cs{k}-2*gs1*gs2/NULLIF(ca{k},0),0) AS cm{k}, {flat}/16*ca{k}*(4+{flat}*(4-3*ca{k})) AS k{k}",
            f"gl+(1-k{k})*{flat}*sa{k}*(arc{k}+k{k}*ss{k}*(cm{k}+k{k}*cs{k}*(2*cm{k}*cm{k}-1))) AS x{k + 1}",
        ]
    z = rounds - 1
    steps += [
        f"ca{z}*(POW(1/(1-{flat}),2)-1) AS gw", "1+gw/16384*(4096+gw*(-768+gw*(320-175*gw))) AS gp, gw/1024*(256+gw*(-128+gw*(74-47*gw))) AS gq",
        f"6378137.0*(1-{flat})/1609.344*gp*(arc{z}-gq*ss{z}*(cm{z}+gq/4*(cs{z}*(2*cm{z}*cm{z}-1)-gq/6*cm{z}*(4*ss{z}*ss{z}-3)*(4*cm{z}*cm{z}-3)))) AS gm",
    ]
    for step in steps:
        rows = f"SELECT *, {step} FROM ({rows})"
    return rows


PAIRS = "SELECT a.station_id, b.station_id AS other_id, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng FROM station a JOIN station b ON a.station_id<>b.station_id"


@query("J7_within_radius_spheroid", "station", f"SELECT station_id, other_id, ROUND(gm, 5) AS miles FROM ({_geodesic(PAIRS, 'a', 'b', 6)}) WHERE gm<=120")
def within_spheroid(station):
    other = station.select(F.col("station_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    return geo.within_spheroid(station.select("station_id", "lat", "lng"), other, 120.0).where("station_id <> other_id").select("station_id", "other_id", F.round("miles", 5).alias("miles"))


@query("C21_spheroid_miles", "station", f"""SELECT station_id, ROUND(gm, 5) AS miles FROM ({_geodesic(PAIRS.replace("a.station_id<>b.station_id", "b.station_id=a.station_id+1"), 'a', 'b', 6)})""")
def chain_spheroid(station):
    nxt = station.select((F.col("station_id") - 1).alias("station_id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return station.join(nxt, "station_id").select("station_id", F.round(spheroid_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 5).alias("miles"))


def _route(station: DataFrame) -> DataFrame:
    return station.select("lane_id", F.col("station_id").alias("seq"), "lat", "lng")


def _spots(station: DataFrame) -> DataFrame:
    return station.select("station_id", (F.col("lat") + 0.2).alias("other_lat"), (F.col("lng") - 0.1).alias("other_lng"))


# Every piece of a route of at most 25 miles with every station, its nearest point in degrees (py, px) and the share of the piece there (t).
PIECES = f"""s AS (SELECT lane_id, station_id, lat, lng, LEAD(lat) OVER w AS lat2, LEAD(lng) OVER w AS lng2 FROM station WINDOW w AS (PARTITION BY lane_id ORDER BY station_id)), d AS (SELECT *, SQRT(POW(lat2-lat,2)+POW(lng2-lng,2)) AS degrees FROM s WHERE lat2 IS NOT NULL),
    b AS (SELECT *, COALESCE(SUM(degrees) OVER (PARTITION BY lane_id ORDER BY station_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, SUM(degrees) OVER (PARTITION BY lane_id) AS total FROM d),
    e AS (SELECT b.*, CAST(GREATEST(1, CEIL({HAVERSINE.replace('{b}.lat', 'lat2').replace('{b}.lng', 'lng2').replace('{a}.', 'b.')}/25.0)) AS BIGINT) AS n FROM b), u AS (SELECT *, UNNEST(range(n)) AS k FROM e),
    c AS (SELECT lane_id, lat+(lat2-lat)*k/n AS lat, lng+(lng2-lng)*k/n AS lng, lat+(lat2-lat)*(k+1)/n AS lat2, lng+(lng2-lng)*(k+1)/n AS lng2, before+degrees*k/n AS before, degrees/n AS degrees, total FROM u),
    o AS (SELECT station_id, lat+0.2 AS olat, lng-0.1 AS olng FROM station), q AS (SELECT c.*, o.*, lat2-lat AS dy, lng2-lng AS dx FROM c, o),
    t AS (SELECT *, LEAST(1.0, GREATEST(0.0, COALESCE(((olat-lat)*dy+(olng-lng)*dx)/NULLIF(dy*dy+dx*dx, 0.0), 0.0))) AS t FROM q), f AS (SELECT *, lat+t*dy AS py, lng+t*dx AS px, (before+t*degrees)/NULLIF(total, 0.0) AS fraction FROM t)"""
AROUND = "2*3958.8*ASIN(LEAST(1.0, SQRT(POW(SIN(RADIANS(py-olat)/2),2)+COS(RADIANS(olat))*COS(RADIANS(py))*POW(SIN(RADIANS(px-olng)/2),2)))) AS perp"
SPHERE = f"{PIECES}, m AS (SELECT *, {AROUND} FROM f), near AS (SELECT lane_id, station_id, ARG_MIN(fraction, (perp, fraction)) AS fraction, MIN(perp) AS perp_miles FROM m GROUP BY 1,2)"
SQUARED = "0.0066943799901413165"  # the spheroid's eccentricity, squared
WIDE = f"POW(COS(RADIANS((lat+lat2)/2))*(1-{SQUARED}*POW(SIN(RADIANS((lat+lat2)/2)),2))/(1-{SQUARED}),2)"
FOOT = f"SELECT *, lat+t2*dy AS flat, lng+t2*dx AS flng FROM (SELECT *, LEAST(1.0, GREATEST(0.0, COALESCE(((olat-lat)*dy+(olng-lng)*dx*wide)/NULLIF(dy*dy+dx*dx*wide, 0.0), 0.0))) AS t2 FROM (SELECT *, {WIDE} AS wide FROM f))"
SPHEROID = f"{PIECES}, m AS ({_geodesic(FOOT, 'o', 'f', 4)}), near AS (SELECT lane_id, station_id, ARG_MIN(fraction, (POW(olat-py,2)+POW(olng-px,2), fraction)) AS fraction, MIN(gm) AS perp_miles FROM m GROUP BY 1,2)"


@query("J6_corridor", "station", f"WITH {SPHERE} SELECT lane_id, station_id, ROUND(fraction, 6) AS fraction, ROUND(perp_miles, 4) AS perp_miles FROM near WHERE perp_miles<=30")
def corridor(station):
    return geo.corridor(_route(station), _spots(station), "lane_id", "seq", 30.0).withColumns({"fraction": F.round("fraction", 6), "perp_miles": F.round("perp_miles", 4)})


@query("J6_corridor_spheroid", "station", f"WITH {SPHEROID} SELECT lane_id, station_id, ROUND(fraction, 6) AS fraction, ROUND(perp_miles, 4) AS perp_miles FROM near WHERE perp_miles<=30")
def corridor_spheroid(station):
    return geo.corridor(_route(station), _spots(station), "lane_id", "seq", 30.0, on_spheroid=True).withColumns({"fraction": F.round("fraction", 6), "perp_miles": F.round("perp_miles", 4)})


@query(
    "R1_corridor_candidates", "station published",
    f"""WITH {SPHEROID}, day AS (SELECT DATE '1970-01-01' + CAST(FLOOR(quantile_cont(datediff('day', DATE '1970-01-01', valid_on), 0.5)) AS INT) AS day FROM published), known AS (SELECT published.station_id, price_t FROM published, day WHERE valid_on=day.day)
    SELECT near.lane_id, near.station_id, ROUND(fraction*900.0, 3) AS mile, ROUND(perp_miles, 4) AS perp_miles, CASE WHEN price_t % 10 <> 0 THEN CAST(price_t AS DOUBLE)/10000.0 END AS price, CASE WHEN price_t IS NULL THEN 'no_price_on_date' WHEN price_t % 10 = 0 THEN 'price_basis_null' END AS excluded
    FROM near JOIN station USING (station_id) LEFT JOIN known USING (station_id) WHERE resolution<>'unresolved' AND station_id % 9 <> 0 AND perp_miles<=25.0+station_id % 5""",
)
def corridor_candidates(station, published):
    """Stations beside the lines through a country's stations, with the price of one day; the day is the table's middle one."""
    day = published.agg(F.expr("percentile(CAST(datediff(valid_on, DATE '1970-01-01') AS DOUBLE), 0.5)").alias("d")).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).alias("day")).first()[0]
    own = station.select("lane_id").distinct().withColumns({"distance": F.lit(900.0), "corridor": F.lit(25.0), "day": F.lit(day)})
    spots = station.select("station_id", (F.col("lat") + 0.2).alias("lat"), (F.col("lng") - 0.1).alias("lng"), F.lit("US").alias("country"), "resolution", F.when(F.col("station_id") % 9 == 0, "excluded").otherwise("unverified").alias("truck_accessible"), (F.col("station_id") % 5).cast("double").alias("uncertainty"))
    prices = published.select("station_id", "valid_on", F.col("price_t").alias("price_id"), F.when(F.col("price_t") % 10 != 0, F.col("price_t") / 10000.0).alias("your_price"))
    return lanes.corridor_candidates(_route(station), own, spots, prices).withColumns({"mile": F.round("mile", 3), "perp_miles": F.round("perp_miles", 4)})


@query(
    "C25_bracket_points", "station",
    """WITH s AS (SELECT lane_id, station_id, lat, lng, LEAD(lat) OVER w AS lat2, LEAD(lng) OVER w AS lng2 FROM station WINDOW w AS (PARTITION BY lane_id ORDER BY station_id)), d AS (SELECT *, SQRT(POW(lat2-lat,2)+POW(lng2-lng,2)) AS degrees FROM s WHERE lat2 IS NOT NULL),
    b AS (SELECT *, COALESCE(SUM(degrees) OVER (PARTITION BY lane_id ORDER BY station_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, SUM(degrees) OVER (PARTITION BY lane_id) AS total FROM d), f AS (SELECT UNNEST([0.0::DOUBLE, 0.25, 0.5, 1.0]) AS fraction),
    j AS (SELECT lane_id, fraction, before, lat, lng, lat2, lng2, CASE WHEN degrees=0 THEN 0 ELSE LEAST(1.0, GREATEST(0.0, (fraction*total-before)/degrees)) END AS t FROM b CROSS JOIN f WHERE fraction*total>=before-1e-9 AND fraction*total<=before+degrees+1e-9)
    SELECT lane_id, fraction, ROUND(ARG_MIN(lat+t*(lat2-lat), before), 6) AS at_lat, ROUND(ARG_MIN(lng+t*(lng2-lng), before), 6) AS at_lng FROM j GROUP BY 1,2""",
)
def bracket_points(station):
    seg = geo.segments(_route(station), "lane_id", "seq")
    wanted = station.select("lane_id").distinct().withColumn("fraction", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(1.0))))
    return geo.point_at(seg, wanted, "lane_id").select("lane_id", "fraction", F.round("at_lat", 6).alias("at_lat"), F.round("at_lng", 6).alias("at_lng"))


@query("A37_route_bounds", "station", "SELECT lane_id, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lng) AS min_lng, MAX(lng) AS max_lng FROM station GROUP BY 1")
def bounds(station):
    return geo.route_bounds(station, "lane_id")


@query("C21_haversine", "station", f"SELECT a.station_id, ROUND({HAVERSINE.format(a='a', b='b')}, 5) AS miles FROM station a JOIN station b ON b.station_id=a.station_id+1")
def chain_miles(station):
    nxt = station.select((F.col("station_id") - 1).alias("station_id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return station.join(nxt, "station_id").select("station_id", F.round(haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 5).alias("miles"))


@query("J22_detour_legs", "lineitem part", f"""WITH c AS ({CANDIDATES}), l AS (SELECT DISTINCT station_id FROM c) SELECT lane_id, station_id, CASE WHEN station_id % 4 <> 0 AND station_id % 5 <> 0 THEN GREATEST(0.0, CAST(station_id % 13 + station_id % 11 AS DOUBLE) - 10.0) END AS detour_miles, CASE WHEN station_id % 4 = 0 OR station_id % 5 = 0 THEN 'detour_unmeasurable' END AS excluded FROM c""")
def detour_legs(lineitem, part):
    cand = candidates(lineitem, part).select("lane_id", "station_id", F.lit(-1).cast("bigint").alias("before_id"), F.lit(-2).cast("bigint").alias("after_id"), F.lit(10.0).alias("arc_miles"))
    s = cand.select("station_id").distinct()
    into = s.where("station_id % 4 <> 0").select(F.lit(-1).cast("bigint").alias("from_id"), F.col("station_id").alias("to_id"), (F.col("station_id") % 13).cast("double").alias("miles"), F.lit(60.0).alias("seconds"))
    out = s.where("station_id % 5 <> 0").select(F.col("station_id").alias("from_id"), F.lit(-2).cast("bigint").alias("to_id"), (F.col("station_id") % 11).cast("double").alias("miles"), F.lit(60.0).alias("seconds"))
    return joins.detour_legs(cand, into.unionByName(out)).select("lane_id", "station_id", "detour_miles", "excluded")
