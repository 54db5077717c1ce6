"""Scalar functions of the model as column expressions; all but two stay in the JVM."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the model.
METERS_PER_MILE = 1609.344
LITERS_PER_GALLON = 3.785411784
EARTH_MILES = 3958.8
# The WGS 84 spheroid in metres.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
DETOUR_FACTOR, DETOUR_FLOOR_MILES, BRACKET_MILES = 1.35, 0.124, 10.0
DEFAULT_CORRIDOR_MILES = 25.0
MINOR_WORDS = ("of", "the", "and", "or")
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()


def clean_header(cell: Column) -> Column:
    """Trimmed, upper case, white space collapsed."""
    return F.regexp_replace(F.upper(F.trim(cell)), r"\s+", " ")


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds half toward plus infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))


def _expand(text: Column) -> Column:
    """Leading Mc, Mt, St and N of a place or person name."""
    text = F.regexp_replace(text, r"^Mc ?([a-zA-Z])", "Mc$1")
    text = F.when(text.rlike(r"^Mc[a-z]"), F.concat(F.lit("Mc"), F.upper(F.substring(text, 3, 1)), F.substring(text, 4, 1_000_000))).otherwise(text)
    text = F.regexp_replace(text, r"^Mt\.? (?=\S)", "Mount ")
    text = F.regexp_replace(text, r"^St\.? (?=\S)", "St. ")
    return F.regexp_replace(text, r"^N\.? (?=\S)", "North ")


def normalize_city(raw: Column) -> Column:
    """Title case for all-capital names (minor words stay low unless first), then leading abbreviations."""
    trimmed = F.trim(raw)
    words = F.transform(
        F.split(trimmed, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*MINOR_WORDS), F.lower(w)).otherwise(_capital(w))
    )
    shouted = (trimmed == F.upper(trimmed)) & trimmed.rlike("[A-Za-z]")
    return _expand(F.when(shouted, F.array_join(words, " ")).otherwise(trimmed))


def normalize_name(raw: Column) -> Column:
    """Separators to spaces, punctuation dropped, title case, leading abbreviations; blank becomes null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[-_/]", " "), r"""['".,()]""", ""), r"\s+", " "))
    titled = F.array_join(F.transform(F.split(text, " "), _capital), " ")
    return F.when(text != "", _expand(titled))


def store_brand(raw: Column) -> Column:
    """C4: the words before '#number', or the whole name."""
    return F.when(raw.rlike(r"^.*?\s*#\s*\d+\s*$"), F.regexp_extract(raw, r"^(.*?)\s*#\s*(\d+)\s*$", 1)).otherwise(F.trim(raw))


def store_number(raw: Column) -> Column:
    """C4: the number after '#', or null."""
    return F.when(raw.rlike(r"#\s*\d+\s*$"), F.regexp_extract(raw, r"#\s*(\d+)\s*$", 1).cast("long"))


def display_case(text: Column, keep: tuple[str, ...]) -> Column:
    """A name without small letters in title case, but for words that stay as they are."""
    titled = F.array_join(F.transform(F.split(text, r"(?<=[^A-Za-z0-9'])|(?=[^A-Za-z0-9'])"), lambda w: F.when(w.isin(*keep), w).otherwise(_capital(w))), "")
    return F.when(text.rlike("[a-z]"), text).otherwise(titled)


def same_unit(entered: Column, unit: Column) -> Column:
    """Equal, or both digits and equal without leading zeros."""
    a, b = F.trim(entered), F.trim(unit)
    both = a.rlike(r"^\d+$") & b.rlike(r"^\d+$")
    return F.when(both, bare_unit(a) == bare_unit(b)).otherwise(a == b)


def bare_unit(unit: Column) -> Column:
    return F.regexp_replace(F.trim(unit), r"^0+(?=\d)", "")


def unit_number(unit: Column) -> Column:
    """A unit of three or four digits, else null."""
    return F.when(F.trim(unit).rlike(r"^\d{3,4}$"), F.trim(unit))


def decimal_text(raw: Column, places: int) -> Column:
    """Plain decimal text with at most `places` decimals as DECIMAL, else null; no exponents, no plus sign."""
    ok = F.trim(raw).rlike(rf"^-?\d+(\.\d{{1,{places}}})?$")
    return F.when(ok, F.trim(raw)).cast(f"decimal(18,{places})")


def cents(amount: Column) -> Column:
    """DECIMAL money as BIGINT cents."""
    return (amount * 100).cast("bigint")


def from_cents(amount: Column) -> Column:
    """BIGINT cents as DECIMAL money."""
    return (amount.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def miles_from_meters(x: Column) -> Column:
    return x / METERS_PER_MILE


def meters_from_miles(x: Column) -> Column:
    return x * METERS_PER_MILE


def km_from_miles(x: Column) -> Column:
    return x * (METERS_PER_MILE / 1000.0)


def gallons_from_liters(x: Column) -> Column:
    return x / LITERS_PER_GALLON


def liters_from_gallons(x: Column) -> Column:
    return x * LITERS_PER_GALLON


def quantity_in(qty: Column, stored: Column, wanted: str) -> Column:
    """A quantity in the wanted unit ('gal' or 'l'), four places; as it is where units agree."""
    made = gallons_from_liters(qty) if wanted == "gal" else liters_from_gallons(qty)
    return F.when(stored == wanted, qty).otherwise(half_up(made, 4))


def per_unit_in(price: Column, stored: Column, wanted: str) -> Column:
    """A price by unit, six places."""
    made = liters_from_gallons(price) if wanted == "gal" else gallons_from_liters(price)
    return F.when(stored == wanted, price).otherwise(half_up(made, 6))


def convert_cents(amount: Column, currency: Column, wanted: str, rate_micro: Column) -> Column:
    """Cents in the wanted currency, rounded once, half away from zero; null without a rate.

    `rate_micro` is CAD for one USD in millionths."""
    a, r = amount.cast("decimal(20,0)"), rate_micro.cast("decimal(20,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    made = F.round(a * r / million, 0) if wanted == "CAD" else F.round(a * million / r, 0)
    return F.when(currency == wanted, amount).otherwise(made.cast("bigint"))


def fx_problem(rate: Column) -> Column:
    """Why a rate can't be used, or null."""
    return (
        F.when(rate.isNull() | F.isnan(rate), "missing")
        .when(rate <= 0, "not positive")
        .when((rate < 0.5) | (rate > 3.0), "out of range")
        .when(F.abs(rate * 1e6 - F.round(rate * 1e6)) > 1e-6, "too many decimals")
    )


def unit_of(currency: Column) -> Column:
    """Gallons for USD, litres for CAD."""
    return F.when(currency == "USD", "gal").when(currency == "CAD", "l")


def currency_of(code: Column) -> Column:
    """US and CN."""
    return F.when(code == "US", "USD").when(code == "CN", "CAD")


def iso_day(text: Column) -> Column:
    """C17: a real calendar day written yyyy-mm-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def raw_resolved(resolved: Column, raw: Column, agrees: Column) -> Column:
    """What was entered beside what it was resolved to; agreement is null with nothing to compare."""
    return F.struct(resolved.alias("resolved"), raw.alias("raw"), F.when(resolved.isNotNull() & (F.trim(raw) != ""), agrees).alias("agrees"))


def station_label(brand: Column, number: Column, name: Column, keep: tuple[str, ...]) -> Column:
    """Brand and store number, or the display-cased name."""
    return F.coalesce(F.when(number.isNotNull(), F.concat(brand, F.lit(" #"), number.cast("string"))), display_case(name, keep))


def neutral_keys(detail: Column) -> Column:
    """C20: money and quantity keys of an older detail map without their unit."""
    return F.transform_keys(detail, lambda k, v: F.when(k == "gallons", F.lit("quantity")).otherwise(F.regexp_replace(k, "Usd(PerGal)?$", "")))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Miles on a sphere; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() skips nulls


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value computed once for the many places of an expression that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spheroid_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rounds: int = 6) -> Column:
    """C21 on the WGS 84 spheroid, by Vincenty's inverse formula; null if a coordinate is.

    A round leaves some 1/300 of the error: six give a millimetre on a continent, and a metre up to 5,500 km in four; near the antipodes
    the formula doesn't settle."""
    f, b, zero = WGS84_F, WGS84_A * (1 - WGS84_F), F.lit(0.0)
    named = lambda **cols: F.struct(*[c.alias(n) for n, c in cols.items()])
    reduced = lambda lat: F.atan(F.tan(F.radians(lat)) * (1 - f))
    turn = F.radians(lng2 - lng1)
    ends = named(s1=F.sin(reduced(lat1)), c1=F.cos(reduced(lat1)), s2=F.sin(reduced(lat2)), c2=F.cos(reduced(lat2)), turn=turn - 2 * math.pi * F.round(turn / (2 * math.pi)))

    def arc(e: Column, x: Column) -> Column:
        """The arc on the auxiliary sphere for one difference of longitude."""
        sine = F.sqrt(F.pow(e.c2 * F.sin(x), 2) + F.pow(e.c1 * e.s2 - e.s1 * e.c2 * F.cos(x), 2))
        first = named(sine=sine, cosine=e.s1 * e.s2 + e.c1 * e.c2 * F.cos(x), cross=e.c1 * e.c2 * F.sin(x))
        second = lambda v: named(sine=v.sine, cosine=v.cosine, azimuth=F.coalesce(v.cross / F.nullif(v.sine, zero), zero), length=F.atan2(v.sine, v.cosine))
        third = lambda v, rest: named(sine=v.sine, cosine=v.cosine, azimuth=v.azimuth, length=v.length, rest=rest, middle=F.coalesce(v.cosine - 2 * e.s1 * e.s2 / F.nullif(rest, zero), zero))
        return _with(_with(first, second), lambda v: _with(1 - v.azimuth * v.azimuth, lambda rest: third(v, rest)))

    def turned(e: Column, v: Column) -> Column:
        """The difference of longitude that belongs to an arc."""
        k = f / 16 * v.rest * (4 + f * (4 - 3 * v.rest))
        return _with(k, lambda k: e.turn + (1 - k) * f * v.azimuth * (v.length + k * v.sine * (v.middle + k * v.cosine * (2 * v.middle * v.middle - 1))))

    def miles(v: Column) -> Column:
        def last(w: Column) -> Column:
            p = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
            q = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
            bend = lambda q: q * v.sine * (v.middle + q / 4 * (v.cosine * (2 * v.middle * v.middle - 1) - q / 6 * v.middle * (4 * v.sine * v.sine - 3) * (4 * v.middle * v.middle - 3)))
            return b / METERS_PER_MILE * p * (v.length - _with(q, bend))

        return _with(v.rest * ((WGS84_A / b) ** 2 - 1), last)

    def whole(e: Column) -> Column:
        x = F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), e.turn, lambda x, _: _with(arc(e, x), lambda v: turned(e, v)))
        return _with(arc(e, x), miles)

    return _with(ends, whole)


def with_spheroid_miles(df: DataFrame, ends: tuple[str, str, str, str], name: str, rounds: int = 6) -> DataFrame:
    """:func:`spheroid_miles` between the named columns (lat, lng, other lat, other lng) as a chain of plain projections, which are compiled: for many pairs.

    Every second round and the last step are row generators of one row: what follows one is compiled as a method of its own, as the JVM leaves long
    ones uncompiled, and no filter on the result is moved below it and written out in the chain's terms."""
    f, b, zero = WGS84_F, WGS84_A * (1 - WGS84_F), F.lit(0.0)
    c = lambda n: F.col(f"_v_{n}")
    lat1, lng1, lat2, lng2 = (F.col(n) for n in ends)
    kept = df.columns
    turn = F.radians(lng2 - lng1)
    steps = [
        {"g1": F.atan(F.tan(F.radians(lat1)) * (1 - f)), "g2": F.atan(F.tan(F.radians(lat2)) * (1 - f)), "turn": turn - 2 * math.pi * F.round(turn / (2 * math.pi))},
        {"s1": F.sin(c("g1")), "c1": F.cos(c("g1")), "s2": F.sin(c("g2")), "c2": F.cos(c("g2")), "x": c("turn")},
    ]
    for k in range(rounds):
        steps += [
            {"sx": F.sin(c("x")), "cx": F.cos(c("x"))}, {"sine": F.sqrt(F.pow(c("c2") * c("sx"), 2) + F.pow(c("c1") * c("s2") - c("s1") * c("c2") * c("cx"), 2)), "cosine": c("s1") * c("s2") + c("c1") * c("c2") * c("cx")},
            {"length": F.atan2(c("sine"), c("cosine")), "azimuth": F.coalesce(c("c1") * c("c2") * c("sx") / F.nullif(c("sine"), zero), zero)}, {"rest": 1 - c("azimuth") * c("azimuth")},
            {"middle": F.coalesce(c("cosine") - 2 * c("s1") * c("s2") / F.nullif(c("rest"), zero), zero), "k": f / 16 * c("rest") * (4 + f * (4 - 3 * c("rest")))},
        ]
        if k < rounds - 1:
            steps.append({"x": c("turn") + (1 - c("k")) * f * c("azimuth") * (c("length") + c("k") * c("sine") * (c("middle") + c("k") * c("cosine") * (2 * c("middle") * c("middle") - 1)))})
    steps += [
        {"w": c("rest") * ((WGS84_A / b) ** 2 - 1)}, {"p": 1 + c("w") / 16384 * (4096 + c("w") * (-768 + c("w") * (320 - 175 * c("w")))), "q": c("w") / 1024 * (256 + c("w") * (-128 + c("w") * (74 - 47 * c("w"))))},
        {"bend": c("q") * c("sine") * (c("middle") + c("q") / 4 * (c("cosine") * (2 * c("middle") * c("middle") - 1) - c("q") / 6 * c("middle") * (4 * c("sine") * c("sine") - 3) * (4 * c("middle") * c("middle") - 3)))},
    ]
    turns = 0
    for step in steps:
        turns += list(step) == ["x"]
        alone = list(step) == ["x"] and turns % 2 == 1
        df = df.withColumns({f"_v_{n}": F.explode(F.array(v)) if alone else v for n, v in step.items()})
    known = (lat1 + lng1 + lat2 + lng2).isNotNull()
    return df.select(*[F.col(n) for n in kept if n != name], F.explode(F.array(F.when(known, b / METERS_PER_MILE * c("p") * (c("length") - c("bend"))))).alias(name))


def detour_estimate(perpendicular: Column) -> Column:
    """C22."""
    return F.when(perpendicular < DETOUR_FLOOR_MILES, 0.0).otherwise(perpendicular * 2 * DETOUR_FACTOR)


def bracket(offset: Column, route: Column, reach: float = BRACKET_MILES) -> tuple[Column, Column, Column]:
    """Start, end and arc length of the stretch around an offset."""
    start, end = F.greatest(F.lit(0.0), offset - reach), F.least(route, offset + reach)
    return start, end, end - start


def measured_detour(there: Column, back: Column, arc: Column) -> Column:
    """Miles of a detour, not below zero."""
    return F.greatest(F.lit(0.0), there + back - arc)


def within_corridor(perpendicular: Column, corridor: Column, uncertainty: Column) -> Column:
    """C26."""
    return perpendicular <= corridor + uncertainty


def city_tier_eligible(uncertainty: Column, slack: Column) -> Column:
    """C27."""
    return (uncertainty < 5) & (slack >= uncertainty * 2)


def uncertainty_radius(square_miles: Column) -> Column:
    """C28."""
    return F.sqrt(square_miles / F.lit(3.141592653589793))


def yes_flag(raw: Column) -> Column:
    """Yes, no or blank."""
    return F.when(F.upper(F.trim(raw)).isin("YES", "Y"), True).when(F.upper(F.trim(raw)).isin("NO", "N"), False)


def parking(raw: Column) -> tuple[Column, Column]:
    """A count of parking spaces, and whether there is any."""
    n = F.when(F.trim(raw).rlike(r"^\d+$"), F.trim(raw).cast("int"))
    return n, F.coalesce(n > 0, yes_flag(raw))


def disclaimers(pairs: list[tuple[Column, str]]) -> Column:
    """Codes whose condition holds, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def round_up_to(x: Column, step: int) -> Column:
    """The next multiple."""
    return F.ceil(x / step) * step


def infeasible_reason(code: Column, gap_start: Column, gap_end: Column, max_leg: Column, max_detour: Column | None = None) -> Column:
    """A code, its gap and what would help; gap and suggestions only for a leg gap, a wider detour only where there is a cap."""
    is_gap, gap = code == "LEG_GAP", gap_end - gap_start
    wider = F.lit(None).cast("double") if max_detour is None else half_up(max_detour + 20, 1)
    tip = lambda action, value: F.struct(F.lit(action).alias("action"), value.cast("double").alias("value"))
    tips = F.filter(
        F.array(F.when(wider.isNotNull(), tip("increaseDetour", wider)), tip("increaseMaxLeg", round_up_to(max_leg + gap, 50)), tip("allowOffNetworkStop", F.lit(None))), lambda x: x.isNotNull()
    )
    none = F.array().cast("array<struct<action:string,value:double>>")
    return F.struct(
        code.alias("code"), F.when(is_gap, gap_start).alias("gap_start"), F.when(is_gap, gap_end).alias("gap_end"), F.when(is_gap, gap).alias("gap_miles"), max_leg.alias("max_leg"), F.when(is_gap, tips).otherwise(none).alias("suggestions")
    )


def maps_link(origin: Column, destination: Column, stops: Column, most: int = 9) -> Column:
    """A directions link with ordered 'lat,lng' way points; more than nine are an error, none is left out in silence."""
    link = F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&origin="), F.url_encode(origin), F.lit("&destination="), F.url_encode(destination),
        F.when(F.size(stops) > 0, F.concat(F.lit("&waypoints="), F.url_encode(F.array_join(stops, "|")))).otherwise(""), F.lit("&travelmode=driving"),
    )
    return F.when(F.size(stops) > most, F.raise_error(F.concat(F.lit(f"a link takes {most} way points, not "), F.size(stops).cast("string")))).otherwise(link)


def plan_defaults(request: dict[str, Column], profile: dict[str, Column]) -> dict[str, Column]:
    """What a request leaves open is taken from the truck's profile, and the corridor from the constant.  A zero is a value; null
    caps on detours and stops mean none and aren't filled."""
    wide = {"max_leg": profile["max_leg"], "min_leg": profile["min_leg"], "corridor": F.lit(DEFAULT_CORRIDOR_MILES), "start": profile["tank"], "min_arrival": profile["reserve"] * profile["tank"]}
    return {name: F.coalesce(request[name], value) if name in request else value for name, value in wide.items()}


def metric_stops(stops: Column) -> Column:
    """Stops (mile, leg_miles, gallons, unit_price) of a plan in kilometres, litres and money a litre."""
    km, litres = METERS_PER_MILE / 1000, LITERS_PER_GALLON
    return F.transform(stops, lambda s: F.struct(
        (s["mile"] * km).alias("km"), (s["leg_miles"] * km).alias("leg_km"), (s["gallons"] * litres).alias("litres"), (s["unit_price"] / litres).alias("unit_price"),
    ))


def arrival_percent(arrival: Column, tank: Column) -> Column:
    """Fuel on arrival as percent of the tank."""
    return arrival / tank * 100


def nice_step(largest: Column) -> Column:
    """An axis step of 1, 2, 2.5, 5 or 10 times a power of ten, about a quarter of the largest value."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(largest / 4)))
    m = largest / 4 / power
    return F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 2.5, 2.5).when(m <= 5, 5.0).otherwise(10.0) * power


def tax_label(hst: Column, gst: Column, pst: Column, qst: Column) -> Column:
    """C36."""
    return F.when((hst > 0) & (gst == 0) & (pst == 0) & (qst == 0), "HST").otherwise("Tax")


def ratio(n: Column, d: Column) -> Column:
    """Null where nothing is divided by."""
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def printed_parts(at: Column) -> Column:
    """Date, time, day key and slash date of the UTC wall clock."""
    return F.struct(
        F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH:mm").alias("time"), F.date_format(at, "yyyyMMdd").alias("day_key"), F.date_format(at, "MM/dd/yyyy").alias("slash_date")
    )


# Address words and their short forms, and state names in the order of STATES.
ADDRESS_WORDS = {
    "suite": "ste", "unit": "ste", "apartment": "ste", "apt": "ste", "#": "ste", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "street": "st",
    "str": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "place": "pl", "parkway": "pkwy", "highway": "hwy", "circle": "cir", "trail": "trl", "terrace": "ter", "square": "sq",
}
STATE_NAMES = (
    "alabama, alaska, arizona, arkansas, california, colorado, connecticut, delaware, district of columbia, florida, georgia, hawaii, idaho, illinois, indiana, iowa, kansas, kentucky, louisiana, maine, maryland, massachusetts, "
    "michigan, minnesota, mississippi, missouri, montana, nebraska, nevada, new hampshire, new jersey, new mexico, new york, north carolina, north dakota, ohio, oklahoma, oregon, pennsylvania, rhode island, south carolina, "
    "south dakota, tennessee, texas, utah, vermont, virginia, washington, west virginia, wisconsin, wyoming"
).split(", ")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(raw: Column) -> Column:
    """The compatibility form that C8 begins with; built-in functions have none."""
    return _nfkc(raw)


def _table(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def normalize_address(raw: Column) -> Column:
    """Compatibility form, lower case, full stops and commas to spaces, five-digit ZIP, the state's name at the end and the known
    words short.  Numbers, other words and their order stay, so unlike places keep unlike keys."""
    text = F.regexp_replace(F.lower(nfkc(raw)), "#", " # ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[.,]", " "), r"(?U)\s+", " "))
    code = F.regexp_extract(text, r"(?:^| )(\d{5})(?:-\d{4})?$", 1)
    body = F.regexp_replace(text, r"(?:^| )\d{5}(?:-\d{4})?$", "")
    longest = "|".join(sorted(STATE_NAMES, key=len, reverse=True))
    state = F.regexp_extract(body, rf"(?:^| )({longest})$", 1)
    short = F.try_element_at(_table(zip(STATE_NAMES, [s.lower() for s in STATES], strict=True)), state)
    body = F.when(state != "", F.concat(F.substring(body, F.lit(1), F.length(body) - F.length(state)), short)).otherwise(body)
    words = F.filter(F.split(body, " "), lambda w: w != "")
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(_table(ADDRESS_WORDS.items()), w), w))
    return F.concat_ws(" ", F.array_join(mapped, " "), F.when(code != "", code))
