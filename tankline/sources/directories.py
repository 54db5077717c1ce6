"""Station directories, operator exports and the gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankline.functions import exprs

# Province names, and legal endings of place names.
PROVINCES = {
    "Alberta": "AB", "British Columbia": "BC", "Manitoba": "MB", "New Brunswick": "NB", "Newfoundland and Labrador": "NL", "Nova Scotia": "NS", "Ontario": "ON", "Prince Edward Island": "PE", "Quebec": "QC",
    "Saskatchewan": "SK",
}
PLACE_ENDINGS = ["city and borough", "municipality", "borough", "village", "township", "town", "city", "CDP"]


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and a byte-order mark; only the columns that are used."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def directory_stations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations, and rows left out with why: blank site, bad coordinates, a site number used twice."""
    number = F.trim("`Site #`")
    twice = F.count("*").over(Window.partitionBy(number)) > 1
    lat, lng = F.col("Latitude").try_cast("double"), F.col("Longitude").try_cast("double")
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    why = F.when(F.coalesce(number, F.lit("")) == "", "blank_site").when(twice, "site_twice").when(lat.isNull() | lng.isNull() | ~lat.between(-90, 90) | ~lng.between(-180, 180), "bad_coordinates")
    spaces, any_parking = exprs.parking(F.col("`Truck Parking`"))
    out = rows.select(
        number.alias("site_ref"), F.trim("`Site Name`").alias("site_name"), F.trim("City").alias("city"), F.coalesce(F.try_element_at(names, F.trim("Province")), F.trim("Province")).alias("state"), F.trim("Country").alias("country"),
        lat.alias("lat"), lng.alias("lng"), exprs.yes_flag(F.col("`DEF at Pump`")).alias("def_at_pump"), spaces.alias("parking_spaces"), any_parking.alias("has_parking"), why.alias("excluded"),
    )
    return out.where("excluded is null").drop("excluded"), out.where("excluded is not null").select("site_ref", "site_name", "excluded")


def operator_rows(rows: DataFrame) -> DataFrame:
    """Rows with a numeric store number that occurs once; prices are never read."""
    number = F.trim("storeNumber").try_cast("int")
    out = rows.select(number.alias("store_number"), *[F.col(c) for c in ("state", "city", "latitude", "longitude")]).where("store_number is not null")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("store_number"))).where("_n = 1").drop("_n")


def strip_ending(name):
    """A place name without its legal ending, the longest one first."""
    endings = "|".join(sorted(PLACE_ENDINGS, key=len, reverse=True))
    return F.regexp_replace(F.trim(name), rf"\s+({endings})$", "")


def gazetteer(places: DataFrame, subdivisions: DataFrame) -> DataFrame:
    """Centroids by (state, normalised name): places before subdivisions, larger land first."""
    shape = lambda d, rank: d.select(
        F.trim("USPS").alias("state"), exprs.normalize_city(strip_ending(F.col("NAME"))).alias("name_normalized"), F.col("ALAND_SQMI").cast("double").alias("land"), F.col("INTPTLAT").cast("double").alias("lat"),
        F.col("INTPTLONG").cast("double").alias("lng"), F.lit(rank).alias("rank"), F.trim("GEOID").alias("geoid"),
    )
    both = shape(places, 0).unionByName(shape(subdivisions, 1)).where(F.col("state").isin(*exprs.STATES) & (F.col("land") > 0))
    w = Window.partitionBy("state", "name_normalized")
    out = both.withColumns({"_r": F.row_number().over(w.orderBy("rank", F.desc("land"), "geoid")), "collisions": F.count("*").over(w) - 1}).where("_r = 1")
    return out.drop("_r", "rank").withColumn("uncertainty_miles", exprs.uncertainty_radius(F.col("land")))


def resolve_tiers(stations: DataFrame, places: DataFrame, export: DataFrame, overrides: DataFrame) -> DataFrame:
    """Q4: each station's coordinates by the best tier: set by hand, the operator's export (exact), the gazetteer's centroid (city, with its
    uncertainty), else unresolved.  Export rows that a hard gate rejects (another state, off the mainland) don't count."""
    from tankline.operators.joins import match_gazetteer, match_operator

    hand = overrides.select("station_id", F.col("lat").alias("h_lat"), F.col("lng").alias("h_lng"))
    both, bad = match_operator(stations, export)
    rows = match_gazetteer(both, places).join(hand, "station_id", "left").join(bad.select("station_id", F.lit(True).alias("_bad")), "station_id", "left")
    exact = F.col("export_lat").isNotNull() & F.col("_bad").isNull()
    how = F.when(F.col("h_lat").isNotNull(), "manual").when(exact, "exact").when(F.col("place_lat").isNotNull(), "city").otherwise("unresolved")
    pick = lambda a: F.coalesce(f"h_{a}", F.when(exact, F.col(f"export_{a}")), f"place_{a}")
    return rows.select("station_id", how.alias("resolution"), pick("lat").alias("lat"), pick("lng").alias("lng"), F.when(how == "city", F.col("uncertainty_miles")).when(how != "unresolved", 0.0).alias("uncertainty_miles"))


def operator_attributes(export: DataFrame) -> DataFrame:
    """store_number, whether trucks may enter (a travel stop with known DEF lanes is verified), and the operator's attributes."""
    spaces, _ = exprs.parking(F.col("parkingSpaces"))
    lanes = F.trim("defLanes").try_cast("int")
    return export.select(
        F.trim("storeNumber").try_cast("int").alias("store_number"), F.when((F.col("storeType") == "Travel Stop") & lanes.isNotNull(), "operator_verified").otherwise("unverified").alias("truck_accessible"),
        F.struct(F.col("storeType").alias("store_type"), spaces.alias("parking_spaces"), lanes.alias("def_lanes")).alias("attributes"),
    )


def upsert_directory(known: DataFrame, new: DataFrame) -> DataFrame:
    """What happens to each directory row: inserted, updated, or collided with a station outside Canada."""
    k = known.select("site_ref", F.col("country").alias("known_country"))
    action = F.when(F.col("known_country").isNull(), "inserted").when(F.col("known_country") == "CA", "updated").otherwise("collided")
    return new.join(k, "site_ref", "left").withColumn("action", action).drop("known_country")


def pick_geocode(candidates: DataFrame) -> DataFrame:
    """Q5: each request's best candidate: matched, ambiguous (ties at the top that name other regions), low_confidence or no_match."""
    w = Window.partitionBy("request_id")
    top = candidates.withColumn("_top", F.max("confidence").over(w))
    out = top.groupBy("request_id").agg(
        F.max("confidence").alias("confidence"), F.count_distinct(F.when(F.col("confidence") == F.col("_top"), F.col("region"))).alias("_regions"), F.max_by("candidate_id", F.struct("confidence", -F.col("candidate_id"))).alias("candidate_id")
    )
    status = F.when(F.col("confidence").isNull(), "no_match").when(F.col("_regions") > 1, "ambiguous").when(F.col("confidence") < 0.9, "low_confidence").otherwise("matched")
    return out.withColumn("status", status).drop("_regions")


def location_problem() -> Column:
    """Q7: why a location (address, lat, lng) can't be used: exactly one form, coordinates in range."""
    has_text, has_point = F.coalesce(F.trim("address"), F.lit("")) != "", F.col("lat").isNotNull() | F.col("lng").isNotNull()
    return (
        F.when(has_text & has_point, "both").when(~has_text & ~has_point, "neither").when(has_point & (F.col("lat").isNull() | F.col("lng").isNull()), "half")
        .when(has_point & (~F.col("lat").between(-90, 90) | ~F.col("lng").between(-180, 180)), "range")
    )


def resolve_addresses(requests: DataFrame, cache: DataFrame, candidates: DataFrame, now) -> DataFrame:
    """Coordinates pass through; else a cache row that hasn't expired; else the picked candidate."""
    key = exprs.normalize_address(F.col("address"))
    live = cache.where(F.col("expires_at") > now).select(F.col("address_norm").alias("_key"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    picked = pick_geocode(candidates).join(candidates.select("request_id", "candidate_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")), ["request_id", "candidate_id"])
    out = requests.withColumn("_key", key).join(live, "_key", "left").join(picked.select("request_id", "status", "p_lat", "p_lng"), "request_id", "left")
    how = F.when(F.col("lat").isNotNull(), "given").when(F.col("c_lat").isNotNull(), "cache").otherwise(F.coalesce("status", F.lit("no_match")))
    usable = F.col("status") == "matched"
    return out.select(
        "request_id", how.alias("how"), F.coalesce("lat", "c_lat", F.when(usable, F.col("p_lat"))).alias("lat"), F.coalesce("lng", "c_lng", F.when(usable, F.col("p_lng"))).alias("lng"), F.col("_key").alias("address_norm")
    )


def touch_cache(cache: DataFrame, hits: DataFrame, now, days: int = 30) -> DataFrame:
    """The cache without expired rows, use counts raised by the hits, new addresses kept for so many days."""
    n = hits.groupBy("address_norm").agg(F.count("*").alias("_n"), F.max("lat").alias("_lat"), F.max("lng").alias("_lng"))
    out = cache.where(F.col("expires_at") > now).join(n, "address_norm", "full")
    return out.select(
        "address_norm", F.coalesce("lat", "_lat").alias("lat"), F.coalesce("lng", "_lng").alias("lng"), (F.coalesce("use_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("use_count"),
        F.coalesce("expires_at", now + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"),
    )
