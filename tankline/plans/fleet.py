"""Registered queries: sinks read back, directories, caches, read models and lists, over the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import exprs as C
from tankline.operators import aggregates as A
from tankline.operators import anomalies as N
from tankline.operators import filters, joins, lanes, sets, windows
from tankline.plans import actuals, files
from tankline.plans.actuals import PLANNED
from tankline.plans.audit import ALL
from tankline.plans.registry import query
from tankline.sources import directories, invoices, price_sheets
from tankline.streaming.jobs import shared_folder

# Invoices and their parts.


def _parsed(stop: DataFrame, line: DataFrame):
    sheets = files.invoice_files(stop, line)
    parts = invoices.sections(sheets)
    return sheets, parts, invoices.fuel_lines(parts, files._codes(line)), invoices.cash_rows(parts), invoices.printed_totals(parts)


OUTCOME = f"""{files.INVOICE}, g AS (SELECT file, stop_id, COUNT(DISTINCT station_id) AS d FROM o GROUP BY 1,2), w AS (SELECT file, MAX(week_end) AS week_end, MAX(wrong) AS wrong, BOOL_OR(product='DF') AS df, BOOL_OR(product='TA') AS ta, BOOL_OR(stop_id % 4 = 1) AS odd FROM o GROUP BY 1),
  good AS (SELECT file FROM g JOIN w USING (file) GROUP BY 1 HAVING MAX(d)=1 AND MAX(CASE WHEN wrong=2 AND df OR wrong=3 AND odd OR wrong=4 AND ta THEN 1 ELSE 0 END)=0)"""


@query(
    "S24_child_tables", "stop line",
    f"""WITH {OUTCOME}, i AS (SELECT * FROM o WHERE file IN (SELECT file FROM good)) SELECT 'lines' AS name, file, COUNT(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'stops', file, COUNT(DISTINCT stop_id) FROM i GROUP BY 2 UNION ALL SELECT 'totals', file, COUNT(DISTINCT product)+2 FROM i GROUP BY 2
    UNION ALL SELECT 'express', file, 1 FROM good UNION ALL SELECT 'manual', file, 1 FROM good UNION ALL SELECT 'cards', NULL, COUNT(DISTINCT card_id) FROM i WHERE card_id % 3 <> 0""",
)
def child_tables(stop, line):
    """Written by billing week, then read back."""
    sheets, parts, fuel, cash, totals = files.parsed(files.invoice_files(stop, line), line)
    ledger = sheets.select(F.lit("").alias("sha256"), F.lit("").alias("invoice_number"), F.lit("1900-01-01").cast("date").alias("week_end"), F.lit("USD").alias("currency")).limit(0)
    known = stop.where("card_id % 3 = 0").select(F.col("card_id").cast("string").alias("card")).distinct()
    decided = files.kept(invoices.decide(sheets, parts, fuel, cash, totals, ledger))  # a row a file, read by every table
    tables = invoices.child_tables(decided, fuel, cash, totals, known)
    folder = shared_folder(stop.sparkSession)
    invoices.write_children(tables, folder)
    out = None
    for name, rows in tables.items():
        back = stop.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
        file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string")
        counts = back.groupBy(file.alias("file")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "file", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


@query("S8_S9_cash_rows", "stop line", f"""WITH {files.INVOICE}, f AS (SELECT file, MAX(week_end) AS day, MAX(currency) AS currency FROM o GROUP BY 1) SELECT file, 'express' AS source, day, 13000 AS amount_c, 100 AS fee_c, 13100 AS total_c, currency, NULL AS payee, 'note' AS notes, FALSE AS bad FROM f
    UNION ALL SELECT file, 'manual', day, -5100, 100, -5000, currency, NULL, 'credit', FALSE FROM f""")  # fmt: skip
def cash_rows(stop, line):
    cents = lambda c: (F.col(c) * 100).cast("int").alias(f"{c}_c")
    return _parsed(stop, line)[3].select("file", "source", "day", cents("amount"), cents("fee"), cents("total"), "currency", "payee", "notes", "bad")


@query("A23_line_checks", "stop line", f"WITH {files.INVOICE} SELECT file, 'discount_rate' AS \"check\", COUNT(*) AS n FROM o WHERE wrong=3 AND stop_id % 4 = 1 GROUP BY 1")
def line_checks(stop, line):
    return invoices.line_checks(_parsed(stop, line)[2]).groupBy("file", "check").agg(F.count("*").alias("n"))


@query("A24_totals_checks", "stop line", f"""WITH {files.INVOICE}, t AS (SELECT DISTINCT file FROM o WHERE wrong=4 AND product='TA') SELECT file, 'TA' AS subject, 'tax_sum' AS "check" FROM t UNION ALL SELECT file, 'Grand Total', 'hst' FROM t UNION ALL SELECT DISTINCT file, 'DF', 'tax_sum' FROM o WHERE wrong=2 AND product='DF'""")
def totals_checks(stop, line):
    return invoices.totals_checks(_parsed(stop, line)[4])


@query(
    "A26_express_weeks", "stop",
    """WITH i AS (SELECT DISTINCT week_end, currency FROM stop), e AS (SELECT week_end, currency, COUNT(*) AS n, CAST(SUM(total_c % 5000) AS BIGINT) AS amount_c, CAST(SUM(100) AS BIGINT) AS fee_c, CAST(SUM(total_c % 5000 + 100) AS BIGINT) AS total_c FROM stop WHERE stop_id % 40 = 3 GROUP BY 1,2)
    SELECT week_end, currency, COALESCE(n,0) AS n, COALESCE(amount_c,0) AS amount_c, COALESCE(fee_c,0) AS fee_c, COALESCE(total_c,0) AS total_c FROM i LEFT JOIN e USING (week_end, currency)""",
)
def express_weeks(stop):
    key = F.concat_ws("-", "week_end", "currency")
    own = stop.where("stop_id % 40 = 3").select(key.alias("invoice_id"), (F.col("total_c") % 5000).alias("amount_c"), F.lit(100).alias("fee_c"), (F.col("total_c") % 5000 + 100).alias("total_c"))
    return A.express_week(own, stop.select("week_end", "currency").distinct().withColumn("invoice_id", key)).drop("invoice_id")


@query("S25_rebuilt_findings", "stop line published", f"{ALL} SELECT rule, subject_id, week_end AS invoice_id FROM allf JOIN (SELECT stop_id, week_end FROM stop) s ON subject_id=s.stop_id WHERE EXTRACT(YEAR FROM week_end)<>1996 OR rule IN ('sub_gallon','def_in_canada')")
def rebuilt_findings(stop, line, published):
    """All findings are stored; then those of one year's invoices are rebuilt with two rules only."""
    folder = f"{shared_folder(stop.sparkSession)}/findings"
    weeks = stop.select(F.col("stop_id").alias("subject_id"), F.col("week_end").alias("invoice_id"))
    every = weeks.select("invoice_id").distinct()
    N.rebuild(N.run(stop, line, published).join(weeks, "subject_id"), every, folder)
    again = N.run(stop, line, published, rules={k: N.RULES[k] for k in ("sub_gallon", "def_in_canada")}).join(weeks, "subject_id")
    N.rebuild(again, every.where(F.year("invoice_id") == 1996), folder)
    return N.stored_findings(stop.sparkSession, folder).select("rule", "subject_id", "invoice_id")


@query("S28_upserted_routes", "event", "SELECT user_id, CAST(value_c % 50 AS INT) AS via_at, MAX(event_id) AS event_id FROM event GROUP BY 1,2")
def upserted_routes(event):
    """A user's events of one value ask for the same route; the latest computed stays."""
    rows = event.select(
        F.lit("ors").alias("provider"), F.col("user_id").alias("origin"), F.lit(1).alias("destination"), F.array((F.col("value_c") % 50).cast("int")).alias("via"), F.lit("truck").alias("truck_spec"), F.col("event_id").alias("computed_at")
    )
    out = sets.upsert_routes(rows.where("computed_at % 2 = 0"), rows.where("computed_at % 2 = 1"))
    return out.select(F.col("origin").alias("user_id"), F.get("via", F.lit(0)).alias("via_at"), F.col("computed_at").alias("event_id"))


@query("S15_read_batch", "line", f"WITH {files.SHEET} SELECT 'sheet-'||strftime(d,'%Y%m')||part||'.csv' AS file, 'OK' AS status, COUNT(*) AS n FROM b GROUP BY d, part UNION ALL SELECT 'broken.csv', 'BAD_HEADER', 0")
def read_batch(line):
    """Sheets written by Spark as one file each, and a broken one, read back from their folder."""
    from pyspark.sql.types import StringType, StructField, StructType

    spark, folder = line.sparkSession, shared_folder(line.sparkSession)
    broken = spark.createDataFrame([("broken.csv", '"Effective Date: ",2020-01-01\nX,Y\n1,2')], StructType([StructField("file", StringType()), StructField("content", StringType())]))
    sheets = files.sheet_files(line).unionByName(broken)
    sheets.select(F.regexp_replace("file", r"\.csv$", "").alias("name"), F.col("content").alias("value")).write.partitionBy("name").option("lineSep", "\n").format("text").save(f"{folder}/sheets")
    found = spark.read.text(f"{folder}/sheets", wholetext=True, recursiveFileLookup=True, pathGlobFilter="part-*").select(F.concat(F.regexp_extract(F.col("_metadata.file_path"), r"name=([^/]+)/", 1), F.lit(".csv")).alias("file"), F.col("value").alias("content"))
    status, rows = price_sheets.parse(found)
    return status.select("file", "status").join(rows.groupBy("file").agg(F.count("*").alias("n")), "file", "left").fillna(0, ["n"])


@query("S17_formats", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'pdf' WHEN c_custkey % 3 = 1 THEN 'csv' ELSE 'unknown' END AS format FROM customer")
def formats(customer):
    content = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "c_name")).otherwise(F.col("c_name")).cast("binary")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 2, ".txt").otherwise(".CSV"))
    return invoices.detect_format(customer.select("c_custkey", name.alias("path"), content.alias("content"))).select("c_custkey", "format")


# Directories, gazetteer, addresses.


def _directory(station: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return station.select(
        F.when(F.col("station_id") % 7 == 0, " ").when(F.col("station_id") % 7 == 1, "T").otherwise(text("station_id")).alias("Site #"), F.col("site_name").alias("Site Name"), F.col("city").alias("City"), F.lit("Ontario").alias("Province"), F.lit("CA").alias("Country"),
        F.when(F.col("station_id") % 7 == 2, "north").otherwise(text("lat")).alias("Latitude"), text("lng").alias("Longitude"), F.when(F.col("station_id") % 2 == 0, "Yes").otherwise("").alias("DEF at Pump"), F.when(F.col("station_id") % 3 == 0, "12").otherwise("No").alias("Truck Parking"), "station_id",
    )


@query("S12_directory", "station", "SELECT CAST(station_id AS VARCHAR) AS site_ref, 'ON' AS state, lat, CASE WHEN station_id % 2 = 0 THEN TRUE END AS def_at_pump, CASE WHEN station_id % 3 = 0 THEN 12 END AS parking_spaces, station_id % 3 = 0 AS has_parking FROM station WHERE station_id % 7 > 2")
def directory(station):
    return directories.directory_stations(_directory(station))[0].select("site_ref", "state", "lat", "def_at_pump", "parking_spaces", "has_parking")


@query("S12_left_out", "station", "SELECT CASE station_id % 7 WHEN 0 THEN 'blank_site' WHEN 1 THEN 'site_twice' ELSE 'bad_coordinates' END AS excluded, COUNT(*) AS n FROM station WHERE station_id % 7 < 3 GROUP BY 1 HAVING excluded<>'site_twice' OR n>1")
def directory_gaps(station):
    return directories.directory_stations(_directory(station))[1].groupBy("excluded").agg(F.count("*").alias("n"))


@query("S22_directory_upsert", "station", "SELECT CAST(station_id AS VARCHAR) AS site_ref, CASE WHEN station_id % 2 = 1 THEN 'inserted' WHEN country='CA' THEN 'updated' ELSE 'collided' END AS action FROM station WHERE station_id % 7 > 2")
def directory_upsert(station):
    known = station.where("station_id % 2 = 0").select(F.col("station_id").cast("string").alias("site_ref"), "country")
    return directories.upsert_directory(known, directories.directory_stations(_directory(station))[0]).select("site_ref", "action")


def _export(station: DataFrame) -> DataFrame:
    number = F.when(F.col("station_id") % 5 == 0, "n/a").when(F.col("station_id") % 5 == 1, "9000001").otherwise(F.col("station_id").cast("string"))
    return station.select(number.alias("storeNumber"), F.when(F.col("station_id") % 5 == 2, "NV").otherwise("TX").alias("state"), "city", F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
        F.when(F.col("station_id") % 2 == 0, "Travel Stop").otherwise("Country Store").alias("storeType"), F.lit("20").alias("parkingSpaces"), F.when(F.col("station_id") % 3 == 0, "4").alias("defLanes"))


@query("S13_operator_rows", "station", "SELECT CAST(station_id AS INT) AS store_number, CASE WHEN station_id % 5 = 2 THEN 'NV' ELSE 'TX' END AS state, lat AS latitude FROM station WHERE station_id % 5 > 1 UNION ALL SELECT 9000001, 'TX', MAX(lat) FROM station WHERE station_id % 5 = 1 HAVING COUNT(*)=1")
def operator_rows(station):
    return directories.operator_rows(_export(station)).select("store_number", "state", "latitude")


@query("C29_attributes", "station", "SELECT CAST(station_id AS INT) AS store_number, CASE WHEN station_id % 6 = 0 THEN 'operator_verified' ELSE 'unverified' END AS truck_accessible, 20 AS parking_spaces FROM station WHERE station_id % 5 > 1")
def attributes(station):
    return directories.operator_attributes(_export(station)).where("store_number < 9000000").select("store_number", "truck_accessible", "attributes.parking_spaces")


@query(
    "J15_operator_match", "station",
    """SELECT s.station_id, e.lat AS export_lat, e.station_id IS NOT NULL AND (e.station_id % 5 = 2 OR NOT (e.lat BETWEEN 24 AND 50 AND e.lng BETWEEN -125 AND -66)) AS rejected FROM station s LEFT JOIN station e ON s.station_id=e.station_id AND e.station_id % 5 > 1""",
)
def operator_match(station):
    own = station.select("station_id", F.col("station_id").cast("int").alias("store_number"), F.lit("TX").alias("state"))
    export = directories.operator_rows(_export(station)).withColumnsRenamed({"latitude": "lat", "longitude": "lng"})
    joined, bad = joins.match_operator(own, export)
    return joined.select("station_id", "export_lat").join(bad.select("station_id", F.lit(True).alias("rejected")), "station_id", "left").fillna(False, ["rejected"])


def _places(customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = lambda part, ending: customer.where(part).select(
        F.when(F.col("c_nationkey") % 3 == 0, "ZZ ").otherwise("TX ").alias("USPS"), F.col("c_custkey").cast("string").alias("GEOID"), F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(ending)).alias("NAME"),
        (F.col("c_custkey") % 97).cast("double").alias("ALAND_SQMI"), (30 + F.col("c_custkey") % 10).cast("double").alias("INTPTLAT"), F.lit(-97.0).alias("INTPTLONG"),
    )
    return base("c_custkey % 4 <> 0", " city"), base("c_custkey % 4 = 0", " township")


GAZETTEER = """k AS (SELECT *, UPPER(c_mktsegment)[1]||LOWER(c_mktsegment)[2:]||' '||CAST(c_nationkey AS VARCHAR) AS name_normalized, c_custkey % 4 = 0 AS sub, c_custkey % 97 AS land FROM customer WHERE c_nationkey % 3 <> 0 AND c_custkey % 97 > 0),
  z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name_normalized ORDER BY sub, land DESC, CAST(c_custkey AS VARCHAR)) AS r, COUNT(*) OVER (PARTITION BY name_normalized)-1 AS collisions FROM k), gz AS (SELECT * FROM z WHERE r=1)"""


@query("S14_gazetteer", "customer", f"WITH {GAZETTEER} SELECT 'TX' AS state, name_normalized, CAST(c_custkey AS VARCHAR) AS geoid, collisions, ROUND(SQRT(land/3.141592653589793), 8) AS uncertainty_miles FROM gz")
def gazetteer(customer):
    out = directories.gazetteer(*_places(customer))
    return out.select("state", "name_normalized", "geoid", "collisions", F.round("uncertainty_miles", 8).alias("uncertainty_miles"))


@query("J14_gazetteer_match", "customer", f"WITH {GAZETTEER} SELECT c.c_custkey, 30.0+g.c_custkey % 10 AS place_lat FROM customer c LEFT JOIN gz g ON UPPER(c.c_mktsegment)||' '||CAST(c.c_nationkey % 7 AS VARCHAR)=UPPER(g.name_normalized)")
def gazetteer_match(customer):
    own = customer.select("c_custkey", F.lit("TX").alias("state"), F.concat(F.upper("c_mktsegment"), F.lit(" "), (F.col("c_nationkey") % 7).cast("string")).alias("city"))
    return joins.match_gazetteer(own, directories.gazetteer(*_places(customer))).select("c_custkey", "place_lat")


@query(
    "Q4_resolution_tiers", "station customer",
    f"""WITH {GAZETTEER}, h AS (SELECT s.station_id, s.lat, s.lng, CASE WHEN s.station_id % 11 = 0 THEN 'manual' WHEN s.station_id % 5 > 2 AND s.lat BETWEEN 24 AND 50 AND s.lng BETWEEN -125 AND -66 THEN 'exact' WHEN g.c_custkey IS NOT NULL THEN 'city' ELSE 'unresolved' END AS resolution, 30.0+g.c_custkey % 10 AS place_lat, SQRT(land/3.141592653589793) AS u
      FROM station s LEFT JOIN gz g ON g.name_normalized='Building '||CAST(s.station_id % 25 AS VARCHAR)) SELECT station_id, resolution, CASE resolution WHEN 'manual' THEN 1.0 WHEN 'exact' THEN lat WHEN 'city' THEN place_lat END AS lat, CASE resolution WHEN 'city' THEN ROUND(u, 8) WHEN 'unresolved' THEN NULL ELSE 0.0 END AS uncertainty_miles FROM h""",
)
def resolution_tiers(station, customer):
    own = station.select("station_id", F.col("station_id").cast("int").alias("store_number"), F.lit("TX").alias("state"), F.concat(F.lit("BUILDING "), (F.col("station_id") % 25).cast("string")).alias("city"))
    export = directories.operator_rows(_export(station)).withColumnsRenamed({"latitude": "lat", "longitude": "lng"})
    hand = station.where("station_id % 11 = 0").select("station_id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    out = directories.resolve_tiers(own, directories.gazetteer(*_places(customer)), export, hand)
    return out.select("station_id", "resolution", "lat", F.round("uncertainty_miles", 8).alias("uncertainty_miles"))


NOW = "TIMESTAMP '2020-01-01 00:00:00'"


def _cache(customer: DataFrame) -> DataFrame:
    """Addresses of even customers; every third of them has expired."""
    when = F.when(F.col("c_custkey") % 3 == 0, F.lit("2019-12-31")).otherwise(F.lit("2020-02-01")).cast("timestamp")
    return customer.where("c_custkey % 2 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(" oak st")).alias("address_norm"), F.lit(5.0).alias("lat"), F.lit(6.0).alias("lng"), F.lit(1).cast("bigint").alias("use_count"), when.alias("expires_at"))


@query("S27_touched_cache", "customer", "SELECT CAST(c_custkey AS VARCHAR)||' oak st' AS address_norm, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 5.0 ELSE 7.0 END AS lat, CAST(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS use_count FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 OR c_custkey % 5 = 0")
def touched_cache(customer):
    hits = customer.where("c_custkey % 5 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(" oak st")).alias("address_norm"), F.lit(7.0).alias("lat"), F.lit(8.0).alias("lng"))
    return directories.touch_cache(_cache(customer), hits.unionByName(hits), F.expr(NOW)).select("address_norm", "lat", "use_count")


@query(
    "Q6_resolved_addresses", "customer",
    """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN 'given' WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'cache' WHEN c_custkey % 5 = 0 THEN 'no_match' WHEN c_custkey % 5 = 1 THEN 'low_confidence' ELSE 'matched' END AS how,
    CASE WHEN c_custkey % 7 = 0 THEN 1.0 WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 5.0 WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE 9.0 END AS lat FROM customer""",
)
def resolved_addresses(customer):
    given = F.when(F.col("c_custkey") % 7 == 0, 1.0)
    requests = customer.select(F.col("c_custkey").alias("request_id"), F.concat(F.col("c_custkey").cast("string"), F.lit("  Oak Street.")).alias("address"), given.alias("lat"), given.alias("lng"))
    found = customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("request_id"), F.lit(1).alias("candidate_id"), F.when(F.col("c_custkey") % 5 == 1, 0.4).otherwise(0.95).alias("confidence"), F.lit("US").alias("region"), F.lit(9.0).alias("lat"), F.lit(9.0).alias("lng"))
    return directories.resolve_addresses(requests, _cache(customer), found, F.expr(NOW)).select("request_id", "how", "lat")


@query("Q7_location_problems", "customer", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'neither' WHEN 2 THEN 'half' WHEN 3 THEN 'range' END AS problem FROM customer")
def location_problems(customer):
    k = F.col("c_custkey") % 5
    rows = customer.select("c_custkey", F.when(k.isin(0, 4), F.col("c_name")).otherwise(" ").alias("address"), F.when(k.isin(0, 2), 1.0).when(k == 3, 91.0).alias("lat"), F.when(k.isin(0, 3), 1.0).alias("lng"))
    return rows.select("c_custkey", directories.location_problem().alias("problem"))


# Filters that need findings, small expressions.


def _findings(stop: DataFrame, line: DataFrame, published: DataFrame) -> DataFrame:
    return N.run(stop, line, published).select(F.col("subject_id").alias("stop_id"), "rule", (F.col("subject_id") % 5 == 0).alias("dismissed"))


@query("F7_with_findings", "stop line published", f"{ALL} SELECT stop_id FROM stop WHERE currency='CAD' AND stop_id IN (SELECT subject_id FROM allf WHERE subject_id % 5 <> 0 AND rule<>'charges_no_fuel')")
def with_findings(stop, line, published):
    return filters.filter_stops(stop, currency="CAD", anomalies=_findings(stop, line, published)).select("stop_id")


@query("F8_flagged", "stop line published", f"{ALL} SELECT stop_id FROM stop WHERE stop_id IN (SELECT subject_id FROM allf WHERE subject_id % 5 <> 0 AND rule IN ('sub_gallon','charges_no_fuel'))")
def flagged(stop, line, published):
    return filters.filter_stops(stop, anomalies=_findings(stop, line, published), flags=["sub_gallon", "charges_no_fuel"]).select("stop_id")


@query("F9_queue_scope", "stop", "SELECT stop_id FROM stop WHERE currency='USD' AND week_end=(SELECT MAX(week_end) FROM stop) AND status<>'confirmed' UNION ALL SELECT stop_id FROM stop WHERE currency='CAD'")
def queue_scope(stop):
    """A scope of one week without confirmed stops, and one of a currency alone."""
    last = stop.agg(F.max("week_end")).first()[0]
    return filters.queue_scope(stop, week=last, currency="USD").select("stop_id").unionByName(filters.queue_scope(stop, currency="CAD", include_confirmed=True).select("stop_id"))


@query("F17_price_bases", "line", "SELECT stop_id, part_id, billed_t AS pump, COALESCE(CASE WHEN tax_p>2 THEN tax_p END,0)+disc_p+part_id AS ifta_net, amount_c AS total_cost FROM line")
def price_bases(line):
    rows = line.select("stop_id", "part_id", F.col("billed_t").alias("your_price"), F.col("amount_c").alias("total_cost"), F.when(F.col("tax_p") > 2, F.col("tax_p")).alias("cost"), F.col("disc_p").alias("freight"), F.lit(None).cast("bigint").alias("other"), F.col("part_id").alias("federal_tax"))
    return rows.select("stop_id", "part_id", *[filters.price_basis(b).alias(b) for b in ("pump", "ifta_net", "total_cost")])


@query("F19_dates_differ", "stop", "SELECT stop_id, truck_id IS NOT NULL AND stop_id % 2 = 0 AS differ FROM stop")
def dates_differ(stop):
    printed = stop.select("stop_id", F.col("day").alias("printed_start"), F.col("day").alias("printed_end"), F.when(F.col("truck_id").isNotNull(), F.col("day")).alias("actual_start"), F.when(F.col("truck_id").isNotNull(), F.date_add("day", (F.col("stop_id") % 2 == 0).cast("int"))).alias("actual_end"))
    return printed.select("stop_id", filters.dates_differ().alias("differ"))


@query("F20_thresholds", "stop line published", f"{ALL} SELECT rule, subject_id FROM allf WHERE rule NOT IN ('sub_gallon','price_above_published')")
def thresholds(stop, line, published):
    """Thresholds from a table of ten rows, two of which nothing exceeds."""
    import json

    odd = {"sub_gallon": {"min_gallons": 0.0}, "price_above_published": {"max_overage_t": 10**15}}
    rows = [(k, json.dumps(v | odd.get(k, {}))) for k, v in N.THRESHOLDS.items()]
    return N.run(stop, line, published, N.load_thresholds(stop.sparkSession.createDataFrame(rows, "rule string, settings string"))).select("rule", "subject_id")


@query("C7_unit_numbers", "stop", "SELECT stop_id, CASE WHEN REGEXP_FULL_MATCH(TRIM(unit_raw), '\\d{3,4}') THEN TRIM(unit_raw) END AS unit FROM stop")
def unit_numbers(stop):
    return stop.select("stop_id", C.unit_number(F.col("unit_raw")).alias("unit"))


@query("C19_station_labels", "station", "SELECT station_id, CASE WHEN station_id % 2 = 0 THEN 'Brand #'||CAST(station_id AS VARCHAR) ELSE 'Main St BVD' END AS label FROM station")
def station_labels(station):
    number = F.when(F.col("station_id") % 2 == 0, F.col("station_id"))
    return station.select("station_id", C.station_label(F.lit("Brand"), number, F.lit("MAIN ST BVD"), ("BVD",)).alias("label"))


@query("C30_plan_defaults", "stop", "SELECT stop_id, CAST(COALESCE(CASE WHEN stop_id % 3 = 0 THEN 0 WHEN stop_id % 3 = 1 THEN 420 END, 500) AS DOUBLE) AS max_leg, 300.0 AS min_leg, CASE WHEN stop_id % 2 = 0 THEN 10.0 ELSE 25.0 END AS corridor, 150.0 AS start, 30.0 AS min_arrival FROM stop")
def plan_defaults(stop):
    request = {"max_leg": F.when(F.col("stop_id") % 3 == 0, 0.0).when(F.col("stop_id") % 3 == 1, 420.0), "min_leg": F.lit(None).cast("double"), "corridor": F.when(F.col("stop_id") % 2 == 0, 10.0)}
    profile = {"max_leg": F.lit(500.0), "min_leg": F.lit(300.0), "tank": F.lit(150.0), "reserve": F.lit(0.2)}
    return stop.select("stop_id", *[v.alias(k) for k, v in C.plan_defaults(request, profile).items()])


@query(
    "C32_infeasible", "stop",
    """SELECT stop_id, CASE WHEN stop_id % 2 = 0 THEN total_c/1e5 + 100 ELSE NULL END AS gap_end, CASE WHEN stop_id % 2 = 0 THEN CASE WHEN stop_id % 4 = 0 THEN 'increaseDetour:45.3,' ELSE '' END||'increaseMaxLeg:'||CAST(CAST(CEIL((500+total_c/1e5)/50)*50 AS BIGINT) AS VARCHAR)||',allowOffNetworkStop:' ELSE '' END AS tips FROM stop""",
)
def infeasible(stop):
    code = F.when(F.col("stop_id") % 2 == 0, "LEG_GAP").otherwise("FUEL_INFEASIBLE")
    reason = C.infeasible_reason(code, F.lit(100.0), F.col("total_c") / 1e5 + 100, F.lit(500.0), F.when(F.col("stop_id") % 4 == 0, 25.25))
    show = lambda s: F.concat(s["action"], F.lit(":"), F.coalesce(F.when(s["action"] == "increaseDetour", s["value"].cast("string")).otherwise(s["value"].cast("bigint").cast("string")), F.lit("")))
    return stop.select("stop_id", reason.alias("r")).select("stop_id", F.col("r.gap_end").alias("gap_end"), F.array_join(F.transform("r.suggestions", show), ",").alias("tips"))


@query("C37_metric_stops", "stop", "SELECT truck_id, COUNT(*) AS n, ROUND(SUM(stop_id % 900)*1.609344, 4) AS km, ROUND(SUM(stop_id % 100)*3.785411784, 4) AS litres FROM stop WHERE truck_id IS NOT NULL GROUP BY 1")
def metric_stops(stop):
    s = F.struct((F.col("stop_id") % 900).cast("double").alias("mile"), F.lit(1.0).alias("leg_miles"), (F.col("stop_id") % 100).cast("double").alias("gallons"), F.lit(4.0).alias("unit_price"))
    plans = stop.where("truck_id is not null").groupBy("truck_id").agg(F.collect_list(s).alias("stops")).select("truck_id", C.metric_stops(F.col("stops")).alias("stops"))
    total = lambda name: F.round(F.aggregate(F.transform("stops", lambda x: x[name]), F.lit(0.0), lambda a, b: a + b), 4).alias(name)
    return plans.select("truck_id", F.size("stops").cast("bigint").alias("n"), total("km"), total("litres"))


@query("C39_delta_texts", "stop", "SELECT stop_id, CASE WHEN total_c % 2000 - 1000 < 0 THEN '-' ELSE '' END||CAST(ABS(total_c % 2000 - 1000)//100 AS VARCHAR)||'.'||LPAD(CAST(ABS(total_c % 2000 - 1000) % 100 AS VARCHAR), 2, '0') AS delta FROM stop")
def delta_texts(stop):
    return stop.select("stop_id", C.from_cents(F.col("total_c") % 2000 - 1000).cast("string").alias("delta"))


@query("C40_arrival_percent", "stop", "SELECT stop_id, (stop_id % 151)/150.0::DOUBLE*100 AS pct FROM stop")
def arrival_percent(stop):
    return stop.select("stop_id", C.arrival_percent((F.col("stop_id") % 151).cast("double"), F.lit(150.0)).alias("pct"))


@query("C34_polylines", "station", "SELECT lane_id, COUNT(*) AS n, ROUND(SUM(ROUND(lat, 5)), 4) AS lat, ROUND(SUM(ROUND(lng, 5)), 4) AS lng FROM station GROUP BY 1")
def polylines(station):
    """Routes encoded by column expressions, decoded again, and summed."""
    from tankline.operators import geo

    w = Window.partitionBy("lane_id").orderBy("station_id")
    five = lambda c: F.round(F.col(c) * 100000).cast("bigint")
    step = lambda c: five(c) - F.coalesce(F.lag(five(c)).over(w), F.lit(0))

    def letters(n):
        left = F.when(n < 0, F.bitwise_not(n * 2)).otherwise(n * 2)
        group = lambda k: F.shiftrightunsigned(left, 5 * k).bitwiseAND(31) + F.when(F.shiftrightunsigned(left, 5 * (k + 1)) > 0, 32).otherwise(0) + 63
        return F.concat(*[F.when((F.lit(k) == 0) | (F.shiftrightunsigned(left, 5 * k) > 0), F.char(group(k))).otherwise("") for k in range(7)])

    parts = station.select("lane_id", "station_id", step("lat").alias("dy"), step("lng").alias("dx")).select("lane_id", "station_id", F.concat(letters(F.col("dy")), letters(F.col("dx"))).alias("p"))
    lines = parts.groupBy("lane_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_id", "p"))), lambda x: x["p"]), "").alias("line"))
    back = geo.decode_polylines(lines, "lane_id", "line").where("error is null")
    return back.groupBy("lane_id").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lng"), 4).alias("lng"))


# Read models and their orders.


@query("J19_best_cards", "stop", """SELECT driver_id, ARG_MIN(card, (s, -created, card)) AS card_id FROM (SELECT driver_id, station_id AS card, CASE WHEN MAX(CASE WHEN status='confirmed' THEN 1 ELSE 0 END)=1 THEN 0 ELSE 1 END AS s, epoch(CAST(MAX(day) AS TIMESTAMP)) AS created FROM stop WHERE driver_id IS NOT NULL AND station_id IS NOT NULL GROUP BY 1,2) GROUP BY 1""")
def best_cards(stop):
    cards = stop.where("driver_id is not null and station_id is not null").groupBy("driver_id", F.col("station_id").alias("card_id")).agg(F.when(F.max((F.col("status") == "confirmed").cast("int")) == 1, "active").otherwise("inactive").alias("status"), F.max("day").alias("created_at"))
    return joins.best_cards(cards).select("driver_id", "card_id")


@query("J21_dispatched_stops", "stop", "SELECT stop_id AS plan_stop_id, CAST(week_end AS VARCHAR) AS period FROM stop WHERE stop_id % 5 <> 0 AND station_id IS NOT NULL AND EXTRACT(YEAR FROM week_end)=1996 AND stop_id % 3 <> 1")
def dispatched(stop):
    plans = stop.select(F.col("stop_id").alias("plan_id"), F.when(F.col("stop_id") % 5 != 0, F.col("occurred_at")).alias("dispatched_at"), "truck_id")
    own = stop.select(F.col("stop_id").alias("plan_id"), F.col("stop_id").alias("plan_stop_id"), "station_id", F.when(F.col("stop_id") % 3 == 1, "rest").otherwise("fuel").alias("stop_type"))
    periods = stop.where(F.year("week_end") == 1996).select(F.date_sub("week_end", 6).alias("period_start"), F.col("week_end").alias("period_end")).distinct()
    return joins.dispatched_stops(plans, own, periods).select("plan_stop_id", F.col("period_end").cast("string").alias("period"))


@query("J25_sheet_counts", "line", "SELECT i.day, i.n_rows, COALESCE(s.n, 0) AS stations FROM (SELECT day, COUNT(*) AS n_rows FROM line WHERE product<>'TA' GROUP BY 1) i LEFT JOIN (SELECT day, COUNT(DISTINCT station_id) AS n FROM line WHERE product='DF' AND stop_id % 4 = 0 GROUP BY 1) s USING (day)")
def sheet_counts(line):
    imports = line.where("product <> 'TA'").groupBy("day").agg(F.count("*").alias("n_rows")).select(F.col("day").alias("import_id"), "n_rows", F.lit("completed").alias("status"))
    return A.price_sheets(imports, line.where("product = 'DF' and stop_id % 4 = 0").select(F.col("day").alias("import_id"), "station_id")).select(F.col("import_id").alias("day"), "n_rows", "stations")


@query("A31_truck_days", "stop line", """SELECT truck_id, CAST(occurred_at AS DATE) AS day, STRING_AGG(CAST(s.station_id AS VARCHAR), '>' ORDER BY occurred_at, s.stop_id) AS route, CAST(SUM(cost_m) AS BIGINT) AS cost_m FROM stop s JOIN (SELECT stop_id, SUM(qty_c*billed_t) AS cost_m FROM line WHERE product='TA' GROUP BY 1) l ON s.stop_id=l.stop_id
    WHERE truck_id IS NOT NULL AND s.station_id IS NOT NULL GROUP BY 1,2""")  # fmt: skip
def truck_days(stop, line):
    return A.truck_days(stop, line).select("truck_id", "day", F.array_join(F.transform("stations", lambda x: x.cast("string")), ">").alias("route"), F.col("cost_m").cast("bigint").alias("cost_m"))


@query("W18_weeks", "stop", "SELECT week_end, STRING_AGG(currency||':'||CAST(n AS VARCHAR), ',' ORDER BY currency DESC) AS invoices FROM (SELECT week_end, currency, COUNT(*) AS n FROM stop GROUP BY 1,2) GROUP BY 1")
def weeks(stop):
    own = stop.groupBy("week_end", "currency").agg(F.count("*").alias("invoice_id"), F.min("day").alias("printed_start"), F.max("day").alias("printed_end"))
    return A.weeks_with_invoices(own).select("week_end", F.array_join(F.transform("invoices", lambda i: F.concat_ws(":", i["currency"], i["invoice_id"].cast("string"))), ",").alias("invoices"))


@query("W5_week_over_week", "stop", """WITH w AS (SELECT currency, week_end, CAST(SUM(total_c) AS BIGINT) AS t FROM stop GROUP BY 1,2), l AS (SELECT *, LAG(t) OVER (PARTITION BY currency ORDER BY week_end) AS b FROM w) SELECT currency, week_end, CASE WHEN b>0 THEN (t-b)*100.0::DOUBLE/b END AS change_pct FROM l WHERE EXTRACT(YEAR FROM week_end)=1997""")
def week_over_week(stop):
    """The change is against the whole list; the year is cut out after it."""
    return windows.change(stop.groupBy("currency", "week_end").agg(F.sum("total_c").alias("t")), "currency", "week_end", "t").where(F.year("week_end") == 1997).select("currency", "week_end", "change_pct")


@query("W10_reprojection", "stop", """WITH m AS (SELECT truck_id, stop_id, CAST(ROW_NUMBER() OVER (PARTITION BY truck_id ORDER BY stop_id)-1 AS DOUBLE) AS old FROM stop WHERE truck_id IS NOT NULL), e AS (SELECT truck_id, MAX(old) AS hi FROM m GROUP BY 1)
    SELECT stop_id, ROUND(CASE WHEN hi=0 THEN 0.0 ELSE old/hi*1000 END, 6) AS moved FROM m JOIN e USING (truck_id)""")  # fmt: skip
def reprojection(stop):
    """Only the ends are anchors: 0 and, if there is another stop, 1000."""
    w = Window.partitionBy("truck_id").orderBy("stop_id")
    m = stop.where("truck_id is not null").select("truck_id", "stop_id", (F.row_number().over(w) - 1).cast("double").alias("old"), F.lead("stop_id").over(w).isNull().alias("last"))
    m = m.withColumn("anchor", F.when(F.col("old") == 0, 0.0).when(F.col("last"), 1000.0))
    return windows.reproject(m, "truck_id", "old", "old", "anchor").select("stop_id", F.round("moved", 6).alias("moved"))


def _ranked(rows: DataFrame, part: list[str], order: list) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


@query("O2_queue_orders", "stop", "SELECT stop_id, ROW_NUMBER() OVER (PARTITION BY week_end ORDER BY occurred_at, stop_id) AS oldest, ROW_NUMBER() OVER (PARTITION BY week_end ORDER BY (status='missing') DESC, occurred_at, stop_id) AS exceptions FROM stop")
def queue_orders(stop):
    ranked = _ranked(stop, ["week_end"], filters.queue_order("oldest")).withColumnRenamed("place", "oldest")
    return _ranked(ranked, ["week_end"], filters.queue_order("exceptions")).select("stop_id", "oldest", F.col("place").alias("exceptions"))


@query("O4_rollup_order", "stop driver", "WITH g AS (SELECT home_id, driver_name, s.driver_id, SUM(total_c) AS t FROM stop s JOIN driver d ON s.driver_id=d.driver_id GROUP BY ALL) SELECT driver_id, ROW_NUMBER() OVER (PARTITION BY home_id ORDER BY t DESC, driver_name, driver_id) AS place FROM g")
def rollup_order(stop, driver):
    g = stop.join(driver, "driver_id").groupBy("home_id", "driver_name", "driver_id").agg(F.sum("total_c").alias("total_c"))
    return _ranked(g, ["home_id"], [F.desc("total_c"), F.collate("driver_name", "UNICODE"), F.asc("driver_id")]).select("driver_id", "place")


@query("O7_variance_order", "stop line", f"WITH {PLANNED}, v AS (SELECT truck_id, COALESCE(SUM(delta_m),0) AS d FROM x WHERE plan_stop_id IS NOT NULL GROUP BY 1) SELECT truck_id, ROW_NUMBER() OVER (ORDER BY d DESC, CAST(truck_id AS VARCHAR)) AS place FROM v ORDER BY 2 LIMIT 100")
def variance_order(stop, line):
    """The hundred trucks that paid most above plan: one page of the list."""
    top = A.truck_variance(actuals._deltas(stop, line)[0]).orderBy(F.desc("delta_m"), F.col("truck_id").cast("string")).limit(100)
    return top.select("truck_id", F.row_number().over(Window.orderBy(F.desc("delta_m"), F.col("truck_id").cast("string"))).alias("place"))


@query("O9_invoice_options", "stop", "SELECT week_end, currency, ROW_NUMBER() OVER (PARTITION BY EXTRACT(YEAR FROM week_end) ORDER BY MAX(occurred_at) DESC, week_end, currency) AS place FROM stop GROUP BY 1,2")
def invoice_options(stop):
    own = stop.groupBy("week_end", "currency").agg(F.max("occurred_at").alias("latest"))
    return _ranked(own.withColumn("y", F.year("week_end")), ["y"], [F.desc("latest"), F.asc("week_end"), F.asc("currency")]).select("week_end", "currency", "place")


@query("O11_cheapest", "line", "SELECT station_id, day, MIN(billed_t) AS billed_t FROM line GROUP BY 1,2")
def cheapest(line):
    return joins.first_per(line, ["station_id", "day"], F.asc("billed_t"), F.asc("stop_id"), F.asc("part_id")).select("station_id", "day", "billed_t")


@query(
    "Q3_assignment_preview", "stop assignment",
    """WITH old AS (SELECT stop_id, a.truck_id AS t FROM stop s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31')),
    n AS (SELECT o.stop_id, o.t AS before, CASE WHEN driver_id % 4 = 0 AND day>=DATE '1998-01-01' AND day<=DATE '1998-12-31' AND driver_id % 9 <> 0 THEN driver_id % 200 + 77 ELSE o.t END AS after FROM old o JOIN stop s ON o.stop_id=s.stop_id)
    SELECT stop_id, CAST(before AS VARCHAR) AS before, CAST(after AS VARCHAR) AS after, CASE WHEN before IS NULL THEN 'cleared' WHEN after IS NULL THEN 'appeared' ELSE 'none' END AS no_truck_flag FROM n WHERE before IS DISTINCT FROM after""",
)
def assignment_preview(stop, assignment):
    """Every fourth driver gets another truck for the rows that cover 1998; nothing is written."""
    moved = (F.col("driver_id") % 4 == 0) & (F.col("valid_from") <= F.lit("1998-01-01").cast("date")) & (F.col("valid_to") >= F.lit("1998-12-31").cast("date"))
    cut = assignment.where(moved)
    after = assignment.where(~moved | moved.isNull()).unionByName(cut.withColumn("valid_to", F.lit("1997-12-31").cast("date"))).unionByName(
        cut.withColumns({"truck_id": F.col("driver_id") % 200 + 77, "valid_from": F.lit("1998-01-01").cast("date"), "valid_to": F.lit("1998-12-31").cast("date")}))
    return N.preview(stop, assignment, after).select("stop_id", "before", "after", "no_truck_flag")


@query(
    "R8_rechecked_legs", "event",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(value_c % 700 AS DOUBLE) AS miles, CAST(value_c * 7 % 150 AS DOUBLE) AS planned, value_c * 7 % 150 + 0 AS pl, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k, COUNT(*) OVER (PARTITION BY user_id) AS n FROM event),
    r AS (SELECT user_id, k, n, miles, 150-miles/5.0 AS arrival, CASE WHEN k=n THEN GREATEST(0.0, 150-miles/5.0) ELSE GREATEST(planned, 150-miles/5.0) END AS departure FROM e WHERE k=1
    UNION ALL SELECT e.user_id, e.k, e.n, e.miles, r.departure-e.miles/5.0, CASE WHEN e.k=e.n THEN GREATEST(0.0, r.departure-e.miles/5.0) ELSE GREATEST(e.planned, r.departure-e.miles/5.0) END FROM e JOIN r ON e.user_id=r.user_id AND e.k=r.k+1)
    SELECT user_id AS lane_id, CAST(k AS INT) AS seq, ROUND(arrival, 6)+0.0 AS arrival, CASE WHEN k<n THEN ROUND(departure-arrival, 6) END AS purchase, miles>500.000001 AS over_cap, CASE WHEN k<n THEN arrival<30-1e-9 ELSE arrival<30-1e-9 END AS short FROM r""",
)
def rechecked_legs(event):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = event.select(F.col("user_id").alias("lane_id"), F.row_number().over(w).alias("seq"), (F.col("value_c") % 700).cast("double").alias("miles"), (F.col("value_c") * 7 % 150).cast("double").alias("planned"), F.lead("event_id").over(w).isNull().alias("last"))
    plan = e.where("not last").select("lane_id", "seq", F.col("seq").alias("station_id"), "planned", F.lit(4.0).alias("price"))
    fixed = {"mpg": 5.0, "tank": 150.0, "reserve": 0.2, "max_leg": 500.0, "min_arrival": 30.0, "start": 150.0}
    own = e.select("lane_id").distinct().withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("within_leg", F.lit(True))
    out = lanes.recheck_legs(plan, e.select("lane_id", "seq", "miles"), own)
    has = lambda *codes: F.exists("violations", lambda x: x.isin(*codes))
    return out.select("lane_id", "seq", F.round("arrival", 6).alias("arrival"), F.round("purchase", 6).alias("purchase"), has("LEG_OVER_CAP").alias("over_cap"), has("BELOW_RESERVE", "BELOW_MIN_ARRIVAL").alias("short"))
