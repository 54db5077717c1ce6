"""J: joins of stops with their dimensions, effective-dated, priority and nearest matches."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import exprs
from tankline.operators.runs import key_runs, whole_runs


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def transactions(stops: DataFrame, lines: DataFrame, drivers: DataFrame, stations: DataFrame, fx: DataFrame) -> DataFrame:
    """Stops with roster, station, the diesel line's figures and the week's rate; dimensions join by key,
    and adaptive execution broadcasts those that turn out small."""
    diesel = lines.where("product = 'TA'").groupBy("stop_id").agg(F.sum("qty_c").alias("ta_qty_c"), F.max("billed_t").alias("ta_billed_t"))
    return (
        stops.join(drivers.select("driver_id", "driver_name"), "driver_id", "left").join(stations.select("station_id", "site_name", "city"), "station_id", "left")
        .join(diesel, "stop_id", "left").join(fx, "week_end", "left")
    )


def exact_date_prices(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Each candidate (station_id, day) with that day's first price, and why it has none."""
    first = first_per(prices, ["station_id", "valid_on"], F.col("price_t").asc_nulls_last())
    joined = candidates.join(first.withColumn("_known", F.lit(True)), (candidates.station_id == first.station_id) & (candidates.day == first.valid_on), "left").drop(first.station_id)
    miss = F.when(F.col("_known").isNull(), "no_price_on_date").when(F.col("price_t").isNull(), "price_basis_null")
    return joined.withColumn("excluded", miss).drop("_known", "valid_on")


def effective_dated(facts: DataFrame, ranges: DataFrame, key: str, day: str = "day", overlapping: bool = False, salts: int = 8) -> DataFrame:
    """The range row of the same key that covers the day (both ends count, an open end never ends).

    Ranges of a key don't overlap (F14; an overlap is an error): so only the range that began last before a day can cover it.  Facts and
    ranges are sorted together once and that range is carried down, which costs their sum where a join costs their product.  A key is
    dealt by its days over `salts` tasks with a copy of its ranges each.  With `overlapping` all ranges that cover a day are joined."""
    far = F.lit("9999-12-31").cast("date")
    if overlapping:
        r = ranges.withColumnRenamed(key, "_key")
        on = (F.col(key) == F.col("_key")) & (F.col(day) >= F.col("valid_from")) & (F.col(day) <= F.coalesce("valid_to", far))
        return facts.join(r, on, "left").drop("_key")
    carried = [c for c in ranges.columns if c != key]
    known = F.col(key).isNotNull() & F.col(day).isNotNull()
    r = ranges.where(F.col(key).isNotNull() & (F.col("valid_from") <= F.coalesce("valid_to", far))).select(
        F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("valid_from").alias("_day"), F.lit(0).alias("_is_fact"),
        F.struct(*carried).alias("_range"), F.coalesce("valid_to", far).alias("_until"),
    )
    f = facts.where(known).select(F.col(key).alias("_key"), F.pmod(F.hash(day), F.lit(salts)).alias("_salt"), F.col(day).cast("date").alias("_day"), F.lit(1).alias("_is_fact"), F.struct(*facts.columns).alias("_fact"))
    w = Window.partitionBy("_key", "_salt").orderBy("_day", "_is_fact")
    before = F.max("_until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = r.unionByName(f, allowMissingColumns=True).withColumns({"_last": F.last(F.when(F.col("_is_fact") == 0, F.struct("_range", "_until")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before": before})
    overlap = F.raise_error(F.concat(F.lit("ranges overlap for key "), F.col("_key").cast("string"))).cast("boolean")
    both = both.where(F.when(F.col("_is_fact") == 1, True).when(F.col("_before") >= F.col("_day"), overlap).otherwise(False))
    hit = F.when(F.col("_last._until") >= F.col("_day"), F.col("_last._range"))
    out = both.select("_fact.*", hit.alias("_hit")).select("*", "_hit.*").drop("_hit")
    return out.unionByName(facts.where(~known), allowMissingColumns=True)


def match_names(rows: DataFrame, aliases: DataFrame, roster: DataFrame, raw: str = "driver_raw") -> DataFrame:
    """Alias first, else roster by normalised name (the smallest id where several share it), else unmatched."""
    key = exprs.normalize_name(F.col(raw))
    alias = aliases.groupBy(exprs.normalize_name(F.col("alias")).alias("_key")).agg(F.min("driver_id").alias("_alias"))
    names = roster.groupBy(exprs.normalize_name(F.col("driver_name")).alias("_key")).agg(F.min("driver_id").alias("_roster"))
    joined = rows.withColumn("_key", key).join(alias, "_key", "left").join(names, "_key", "left")
    how = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_roster").isNotNull(), "roster").otherwise("unmatched")
    return joined.withColumn("matched_id", F.coalesce("_alias", "_roster")).withColumn("matched_by", how).drop("_key", "_alias", "_roster")


def match_stations(rows: DataFrame, stations: DataFrame, ref: str = "site_ref", name: str = "site_name") -> DataFrame:
    """Trimmed site reference, else the store number in the name, else null."""
    by_ref = stations.groupBy(F.trim("site_ref").alias("_ref")).agg(F.min("station_id").alias("_by_ref"))
    by_number = stations.where("store_number is not null").groupBy(F.col("store_number").alias("_number")).agg(F.min("station_id").alias("_by_number"))
    joined = rows.withColumn("_ref", F.trim(ref)).withColumn("_number", exprs.store_number(F.col(name))).join(by_ref, "_ref", "left").join(by_number, "_number", "left")
    return joined.withColumn("matched_id", F.coalesce("_by_ref", "_by_number")).drop("_ref", "_number", "_by_ref", "_by_number")


def match_units(rows: DataFrame, trucks: DataFrame, raw: str = "unit_raw") -> DataFrame:
    """The exact unit, else the only one that is equal without leading zeros; an ambiguous one matches nothing."""
    exact = trucks.groupBy(F.trim("unit_number").alias("_unit")).agg(F.min("truck_id").alias("_exact"))
    bare = trucks.groupBy(exprs.bare_unit(F.col("unit_number")).alias("_bare")).agg(F.min("truck_id").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    joined = rows.withColumn("_unit", F.trim(raw)).withColumn("_bare", exprs.bare_unit(F.col(raw))).join(exact, "_unit", "left").join(bare, "_bare", "left")
    return joined.withColumn("matched_id", F.coalesce("_exact", "_only")).drop("_unit", "_bare", "_exact", "_only")


def match_gazetteer(stations: DataFrame, places: DataFrame) -> DataFrame:
    """Stations by state and normalised city."""
    key = places.select(F.col("state").alias("_s"), F.col("name_normalized").alias("_c"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"), "uncertainty_miles")
    on = (F.col("state") == F.col("_s")) & (exprs.normalize_city(F.col("city")) == F.col("_c"))
    return stations.join(key, on, "left").drop("_s", "_c")


def match_operator(stations: DataFrame, export: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations by store number, and the hard gates: rows whose states disagree or that lie outside the mainland."""
    e = export.select(F.col("store_number").alias("_n"), F.col("state").alias("export_state"), F.col("lat").alias("export_lat"), F.col("lng").alias("export_lng"))
    joined = stations.join(e, F.col("store_number") == F.col("_n"), "left").drop("_n")
    outside = ~(F.col("export_lat").between(24, 50) & F.col("export_lng").between(-125, -66))
    bad = joined.where("export_state is not null").where((F.col("state") != F.col("export_state")) | outside)
    return joined, bad


def dispatched_stops(plans: DataFrame, plan_stops: DataFrame, periods: DataFrame) -> DataFrame:
    """Fuel stops at a station of plans that were dispatched on a UTC day of an invoice's period."""
    own = plan_stops.where("stop_type = 'fuel' and station_id is not null").join(plans.where("dispatched_at is not null"), "plan_id").withColumn("day", F.to_date("dispatched_at"))
    return own.join(periods, (F.col("day") >= F.col("period_start")) & (F.col("day") <= F.col("period_end")))


def consume(plans, fills) -> list[tuple[int, int]]:
    """(plan_stop_id, stop_id): each plan stop in order takes the fill nearest in time that is free, ties the earlier and then the smaller id.

    Both are sorted by micros and id."""
    ids, plan_ids = fills["stop_id"].tolist(), plans["plan_stop_id"].tolist()
    return [(plan_ids[i], ids[j]) for i, j in enumerate(_nearest_free(plans["micros"].tolist(), fills["micros"].tolist()))]


def _nearest_free(wanted: list[int], times: list[int]) -> list[int]:
    """For each time wanted, in order, the place of the nearest of `times` (sorted) that is free yet; shorter when none is left.

    `ahead[k]` leads to the first free place at or after k, `back[k]` to the last free one before it; paths are halved as they are walked."""
    n = len(times)
    ahead, back = list(range(n + 1)), list(range(n + 1))

    def root(lead: list[int], k: int) -> int:
        while lead[k] != k:
            lead[k] = lead[lead[k]]
            k = lead[k]
        return k

    out = []
    for at in wanted:
        k = bisect_left(times, at)
        right, left = root(ahead, k), root(back, k) - 1
        if left >= 0 and (right == n or at - times[left] <= times[right] - at):
            taken = root(ahead, bisect_left(times, times[left]))  # the smallest free id of that time
        elif right < n:
            taken = right
        else:
            break
        out.append(taken)
        ahead[taken], back[taken + 1] = taken + 1, taken
    return out


def _match_runs(table: pa.Table, keys: list[str], plan_figures: list[str], fill_figures: list[str]) -> pa.RecordBatch:
    """All rows of :func:`plan_actual` for whole keys, whose plan stops and fills are sorted by micros and id together."""
    starts, plan = key_runs(table, keys), table["plan"].to_numpy()
    ends = np.append(starts[1:], len(table))
    before = np.concatenate(([0], np.cumsum(plan)))
    n_plans = before[ends] - before[starts]
    mate = np.full(len(table), -1)
    micros = table["micros"].to_numpy()
    for start, end in zip(*(x[(n_plans > 0) & (n_plans < ends - starts)].tolist() for x in (starts, ends)), strict=True):
        own = plan[start:end]
        wanted, fills = np.flatnonzero(own) + start, np.flatnonzero(~own) + start
        found = _nearest_free(micros[wanted].tolist(), micros[fills].tolist())
        mate[wanted[: len(found)]] = fills[found]
    used = np.zeros(len(table), bool)
    used[mate[mate >= 0]] = True
    kept = np.flatnonzero(plan | ~used)
    own, ids = plan[kept], table["id"].combine_chunks()
    fill = pa.array(np.where(own, mate[kept], kept), mask=own & (mate[kept] < 0))
    out = {k: table[k].take(pa.array(kept)).combine_chunks() for k in keys}
    out["plan_stop_id"], out["stop_id"] = ids.take(pa.array(kept, mask=~own)), ids.take(fill)
    out["kind"] = pa.array(np.where(own, np.where(mate[kept] >= 0, "matched", "skipped_recommendation"), "unplanned_stop"), pa.string())
    out |= {c: table[c].combine_chunks().take(pa.array(kept, mask=~own)) for c in plan_figures}
    out |= {c: table[c].combine_chunks().take(fill) for c in fill_figures}
    return pa.RecordBatch.from_pydict(out)


def plan_actual(planned: DataFrame, actual: DataFrame, plan_figures: tuple[str, ...] = (), fill_figures: tuple[str, ...] = ()) -> DataFrame:
    """Each planned stop (plan_stop_id, truck_id, day, station_id, dispatched_at) and each actual one (stop_id, same keys,
    occurred_at, split_fill) used at most once; day is the UTC day of dispatch and of the fill.  Within a key the plan stop dispatched
    first chooses first, the actual nearest in time, ties the earlier.  Leftovers: `skipped_recommendation` and `unplanned_stop`; split
    fills and actuals without a station are left out (:func:`match_exclusions`).

    Both sides are sorted together once, by key and time, and a task matches its keys as they pass: each plan stop finds the nearest free fill
    on either side by bisection and a set of free runs, n log n a key, and no pair is formed.  The named figures of either side go along with
    their rows, so nothing need be joined to the matches again."""
    keys = ["truck_id", "day", "station_id"]
    a = actual.where("station_id is not null and not coalesce(split_fill, false)")
    p = planned.where("dispatched_at is not null and truck_id is not null")
    side = lambda rows, name, at, plan, figures: rows.select(*keys, F.lit(plan).alias("plan"), F.col(name).cast("long").alias("id"), F.unix_micros(at).alias("micros"), *figures)
    both = side(p, "plan_stop_id", "dispatched_at", True, plan_figures).unionByName(side(a, "stop_id", "occurred_at", False, fill_figures), allowMissingColumns=True)
    known = F.concat(*[F.col(c).cast("string") for c in (*keys, "micros")]).isNotNull()
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    figures = [*plan_figures, *fill_figures]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "plan_stop_id long, stop_id long, kind string", *(f"{c} {kinds[c]}" for c in figures)])

    def match(batches):
        for table in whole_runs(batches, keys):
            yield _match_runs(table, keys, plan_figures, fill_figures)

    matched = both.where(known).repartition(*keys).sortWithinPartitions(*keys, "micros", "id").mapInArrow(match, schema)
    alone = both.where(~known).select(
        *keys, F.when(F.col("plan"), F.col("id")).alias("plan_stop_id"), F.when(~F.col("plan"), F.col("id")).alias("stop_id"),
        F.when(F.col("plan"), "skipped_recommendation").otherwise("unplanned_stop").alias("kind"), *figures,
    )
    return matched.unionByName(alone)


def match_exclusions(actual: DataFrame) -> DataFrame:
    """One row: how many actual stops are split fills, and how many others have no station."""
    split = F.coalesce("split_fill", F.lit(False))
    return actual.agg(F.count_if(split).alias("split_fill"), F.count_if(~split & F.col("station_id").isNull()).alias("unresolved_station"))


def match_deltas(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """The rows of :func:`plan_actual` with the money that the plan's price (price_t) and the billed one (billed_t) make of the fuel (qty_c) of
    matched ones, and their difference, in ten-thousandths of cents; null for all others."""
    out = plan_actual(planned, actual, ("price_t",), ("qty_c", "billed_t")).withColumns({"planned_m": F.col("price_t") * F.col("qty_c"), "actual_m": F.col("billed_t") * F.col("qty_c")})
    both = F.col("kind") == "matched"
    out = out.withColumn("delta_m", F.when(both, F.col("actual_m") - F.col("planned_m"))).withColumns({c: F.when(both, F.col(c)) for c in ("planned_m", "actual_m")})
    return out.select("truck_id", "day", "station_id", "plan_stop_id", "stop_id", "kind", "planned_m", "actual_m", "delta_m")


def detour_legs(candidates: DataFrame, legs: DataFrame) -> DataFrame:
    """Measured detour of each candidate from its legs in and out, or why it has none.

    candidates: lane_id, station_id, before_id, after_id, arc_miles; legs: from_id, to_id, miles, seconds."""
    into = legs.select(F.col("from_id").alias("before_id"), F.col("to_id").alias("station_id"), F.col("miles").alias("miles_in"), F.col("seconds").alias("seconds_in"))
    out = legs.select(F.col("from_id").alias("station_id"), F.col("to_id").alias("after_id"), F.col("miles").alias("miles_out"), F.col("seconds").alias("seconds_out"))
    joined = candidates.join(into, ["before_id", "station_id"], "left").join(out, ["station_id", "after_id"], "left")
    known = F.col("miles_in").isNotNull() & F.col("miles_out").isNotNull()
    return joined.withColumn("detour_miles", F.when(known, exprs.measured_detour(F.col("miles_in"), F.col("miles_out"), F.col("arc_miles")))).withColumn("excluded", F.when(~known, "detour_unmeasurable"))


def best_cards(cards: DataFrame) -> DataFrame:
    """Each driver's card: active before others, the newest, the smallest id."""
    return first_per(cards, ["driver_id"], F.desc(F.col("status") == "active"), F.desc("created_at"), F.asc("card_id"))


def roster_outer(roster: DataFrame, activity: DataFrame, key: str, zeros: list[str]) -> DataFrame:
    """Every roster row, zeros where nothing happened, and the row of activity without a key."""
    known = roster.join(activity.where(F.col(key).isNotNull()), key, "left").fillna(0, zeros)
    return known.unionByName(activity.where(F.col(key).isNull()), allowMissingColumns=True)


def batch_misses(stops: DataFrame, express: DataFrame, cards: DataFrame, trucks: DataFrame, stations: DataFrame) -> DataFrame:
    """Q1: what a batch names and nothing knows, with its number of rows: kind (card, truck, station or unit), miss, n.

    stops: card_id, station_id and the resolved truck_id; express: unit_raw.  A card off the roster is a card's miss and not a truck's; a
    stop without a station is a miss of null; a blank unit is none.  Misses stay null or missing in the data, never guessed."""
    unit = F.trim("unit_raw")
    missed = [
        stops.join(cards.select("card_id"), "card_id", "left_anti").select(F.lit("card").alias("kind"), F.col("card_id").cast("string").alias("miss")),
        stops.where("truck_id is null").join(cards.select("card_id"), "card_id", "left_semi").select(F.lit("truck").alias("kind"), F.col("card_id").cast("string").alias("miss")),
        stops.join(stations.select("station_id"), "station_id", "left_anti").select(F.lit("station").alias("kind"), F.col("station_id").cast("string").alias("miss")),
        express.select(unit.alias("unit")).where("unit <> ''").join(trucks.select("unit"), "unit", "left_anti").select(F.lit("unit").alias("kind"), F.col("unit").alias("miss")),
    ]
    return missed[0].unionByName(missed[1]).unionByName(missed[2]).unionByName(missed[3]).groupBy("kind", "miss").agg(F.count("*").alias("n"))
