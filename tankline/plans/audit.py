"""Registered queries: anomaly rules, their runner, differences of findings, truck resolution."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tankline.operators import anomalies as N
from tankline.operators import joins, reresolution, sets
from tankline.plans.registry import query
from tankline.streaming.jobs import shared_folder

LITERS = 3.785411784
SAME = "(CASE WHEN REGEXP_FULL_MATCH(TRIM(unit_raw), '\\d+') THEN REGEXP_REPLACE(TRIM(unit_raw), '^0+(\\d)', '\\1') = CAST(truck_id AS VARCHAR) ELSE TRIM(unit_raw) = CAST(truck_id AS VARCHAR) END)"
#: One SELECT (subject_id, severity, detail) for each rule.
RULES = {
    "sub_gallon": f"""SELECT stop_id AS subject_id, 'red' AS severity, CAST(qty_c AS VARCHAR) AS detail FROM (SELECT l.stop_id, qty_c, ROW_NUMBER() OVER (PARTITION BY l.stop_id ORDER BY product, qty_c) AS r FROM line l JOIN stop s ON l.stop_id=s.stop_id
      WHERE product='TA' AND qty_c>0 AND (CASE WHEN currency='CAD' THEN qty_c/100.0/{LITERS}::DOUBLE ELSE qty_c/100.0 END)<1.0) WHERE r=1""",
    "unit_mismatch": f"SELECT stop_id AS subject_id, 'amber' AS severity, TRIM(unit_raw) AS detail FROM stop WHERE truck_id IS NOT NULL AND TRIM(unit_raw)<>'' AND NOT {SAME}",
    "no_truck_on_file": "SELECT stop_id AS subject_id, 'amber' AS severity, CASE WHEN driver_id IS NULL THEN 'no_driver' ELSE 'no_assignment' END AS detail FROM stop WHERE truck_id IS NULL",
    "unit_not_entered": "SELECT stop_id AS subject_id, 'amber' AS severity, '' AS detail FROM stop WHERE TRIM(unit_raw)=''",
    "driver_not_entered": "SELECT stop_id AS subject_id, 'red' AS severity, '' AS detail FROM stop WHERE TRIM(driver_raw)=''",
    "not_on_roster": "SELECT stop_id AS subject_id, 'red' AS severity, CAST(card_id AS VARCHAR) AS detail FROM stop WHERE driver_id IS NULL",
    "too_close": """SELECT stop_id AS subject_id, 'amber' AS severity, CAST(gap//60000000 AS VARCHAR)||':'||CAST(p AS VARCHAR) AS detail FROM (SELECT stop_id, LAG(stop_id) OVER (PARTITION BY card_id, station_id ORDER BY occurred_at, stop_id) AS p, epoch_us(occurred_at)-LAG(epoch_us(occurred_at)) OVER (PARTITION BY card_id, station_id ORDER BY occurred_at, stop_id) AS gap FROM stop WHERE station_id IS NOT NULL) WHERE gap<=7200000000""",
    "charges_no_fuel": """SELECT stop_id AS subject_id, 'amber' AS severity, products AS detail FROM (SELECT stop_id, SUM(CASE WHEN product IN ('TA','DF') THEN qty_c ELSE 0 END) AS fuel, SUM(amount_c) AS amount, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT product)), ',') AS products FROM line GROUP BY 1)
      WHERE fuel<=0 AND amount>0 AND stop_id IN (SELECT stop_id FROM stop)""",
    "def_in_canada": "SELECT stop_id AS subject_id, 'amber' AS severity, CAST(CAST(SUM(amount_c) AS BIGINT) AS VARCHAR) AS detail FROM line WHERE product='DF' AND stop_id IN (SELECT stop_id FROM stop WHERE currency='CAD') GROUP BY 1",
    "price_above_published": """SELECT stop_id AS subject_id, 'red' AS severity, CAST(over_t AS VARCHAR) AS detail FROM audit WHERE status='flagged'""",
}
AUDIT = """audit AS (SELECT s.stop_id, billed_t-price_t AS over_t, CASE WHEN currency='CAD' THEN 'canadian_stop' WHEN s.station_id IS NULL THEN 'unresolved_station' WHEN price_t IS NULL THEN 'no_price_that_day' WHEN billed_t-price_t>1000 THEN 'flagged' ELSE 'clean' END AS status
  FROM stop s JOIN (SELECT stop_id, MAX(billed_t) AS billed_t FROM line WHERE product='TA' GROUP BY 1) d ON s.stop_id=d.stop_id LEFT JOIN published p ON s.station_id=p.station_id AND s.day=p.valid_on)"""
ALL = f"WITH {AUDIT}, allf AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({v})" for k, v in RULES.items()) + ")"


#: Fills are months apart in the given tables, so the rule for neighbours is run with ninety days too.
NINETY_DAYS = 129_600


def _single(number: int, name: str):
    config = {"max_minutes": NINETY_DAYS} if name == "too_close" else N.THRESHOLDS[name]
    sql = f"WITH {AUDIT} SELECT '{name}' AS rule, * FROM ({RULES[name].replace('gap<=7200000000', f'gap<={NINETY_DAYS * 60_000_000}')})"
    query(f"N{number}_{name}", "stop line published", sql)(lambda stop, line, published: N.RULES[name](stop, line, published, config))


for number, name in enumerate(["sub_gallon", "unit_mismatch", "no_truck_on_file", "unit_not_entered", "driver_not_entered", "not_on_roster", "too_close", "charges_no_fuel", "def_in_canada", "price_above_published"], 1):
    _single(number, name)


@query("N_all_rules", "stop line published", f"{ALL} SELECT * FROM allf")
def all_rules(stop, line, published):
    return N.run(stop, line, published)


@query(
    "A28_freshness", "stop line published event",
    f"""{ALL} SELECT (SELECT MAX(valid_on) FROM published) AS latest_sheet, (SELECT MAX(week_end) FROM stop) AS latest_week, (SELECT COUNT(*) FROM allf WHERE subject_id % 5 <> 0) AS open_findings, (SELECT GREATEST(0, 100000-COUNT(*)) FROM event WHERE event_type='view') AS remaining""",
)
def freshness(stop, line, published, event):
    """One row; every fifth stop's findings are dismissed."""
    sheet = published.agg(F.max("valid_on").alias("latest_sheet")).join(stop.agg(F.max("week_end").alias("latest_week")))
    found = N.run(stop, line, published).agg(F.count_if(F.col("subject_id") % 5 != 0).alias("open_findings"))
    return sheet.join(found).join(event.agg(F.greatest(F.lit(0), 100000 - F.count_if(F.col("event_type") == "view")).alias("remaining")))


@query("N10_not_computable", "stop line published", f"WITH {AUDIT} SELECT stop_id, status FROM audit WHERE status NOT IN ('flagged','clean')")
def not_computable(stop, line, published):
    return N.not_computable(stop, line, published)


@query("A1_rollup_with_findings", "stop line published", f"{ALL} SELECT driver_id, COUNT(*) AS stops, CAST(COALESCE(SUM(n),0) AS BIGINT) AS anomalies FROM stop LEFT JOIN (SELECT subject_id, COUNT(*) AS n FROM allf GROUP BY 1) f ON stop_id=subject_id GROUP BY 1")
def rollup_with_findings(stop, line, published):
    from tankline.operators.aggregates import rollup

    return rollup(stop, line, "driver_id", N.run(stop, line, published).withColumnRenamed("subject_id", "stop_id")).select("driver_id", "stops", "anomalies")




@query(
    "U6_findings_diff", "stop line published",
    f"""{ALL.replace("allf AS (", "allf AS MATERIALIZED (")}, aft AS (SELECT rule, subject_id, severity, CASE WHEN rule='def_in_canada' AND subject_id % 3 = 0 THEN 'x' ELSE detail END AS detail FROM allf WHERE NOT (rule='not_on_roster' AND subject_id % 2 = 0)), bef AS (SELECT * FROM allf WHERE NOT (rule='unit_not_entered' AND subject_id % 2 = 0)),
    g AS (SELECT rule, subject_id, MAX(severity || '|' || detail) FILTER (side=0) AS old, MAX(severity || '|' || detail) FILTER (side=1) AS new FROM (SELECT *, 0 AS side FROM bef UNION ALL SELECT *, 1 AS side FROM aft) GROUP BY 1,2)
    SELECT rule, subject_id, CASE WHEN new IS NULL THEN 'cleared' WHEN old IS NULL THEN 'appeared' ELSE 'changed' END AS change FROM g WHERE old IS DISTINCT FROM new""",
)
def findings_diff(stop, line, published):
    every = N.run(stop, line, published)  # its exchanges serve both sides
    odd = F.col("subject_id") % 2 == 0
    before = every.where(~((F.col("rule") == "unit_not_entered") & odd))
    after = every.where(~((F.col("rule") == "not_on_roster") & odd)).withColumn("detail", F.when((F.col("rule") == "def_in_canada") & (F.col("subject_id") % 3 == 0), "x").otherwise(F.col("detail")))
    return sets.diff_findings(before, after)


@query("A35_change_counts", "stop line published", f"{ALL} SELECT rule, severity, COUNT(*) AS n FROM allf GROUP BY 1,2")
def change_counts(stop, line, published):
    return N.run(stop, line, published).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(
    "J10_resolved_trucks", "stop assignment",
    f"""WITH j AS (SELECT stop_id, a.truck_id, unit_raw FROM (SELECT stop_id, driver_id, day, unit_raw FROM stop) s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31'))
    SELECT stop_id, truck_id, CASE WHEN truck_id IS NOT NULL AND TRIM(unit_raw)<>'' THEN {SAME} END AS agrees FROM j""",
)
def resolved_trucks(stop, assignment):
    return N.resolve_trucks(stop, assignment).select("stop_id", "truck_id", "agrees")


@query(
    "Q1_resolution_misses", "stop assignment",
    """WITH j AS (SELECT s.driver_id, a.truck_id FROM stop s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31'))
    SELECT CASE WHEN driver_id IS NULL THEN 'card' ELSE 'truck' END AS kind, COUNT(*) AS misses FROM j WHERE truck_id IS NULL GROUP BY 1""",
)
def misses(stop, assignment):
    out = N.resolve_trucks(stop, assignment).where("truck_id is null")
    return out.groupBy(F.when(F.col("driver_id").isNull(), "card").otherwise("truck").alias("kind")).agg(F.count("*").alias("misses"))


@query(
    "Q1_batch_misses", "stop assignment driver station",
    """WITH k AS (SELECT driver_id AS card_id FROM driver WHERE driver_id % 10 <> 0), j AS (SELECT s.card_id, s.station_id, a.truck_id FROM stop s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31')),
    m AS (SELECT 'card' AS kind, CAST(card_id AS VARCHAR) AS miss FROM j WHERE card_id NOT IN (SELECT card_id FROM k) UNION ALL SELECT 'truck', CAST(card_id AS VARCHAR) FROM j WHERE truck_id IS NULL AND card_id IN (SELECT card_id FROM k)
      UNION ALL SELECT 'station', CAST(j.station_id AS VARCHAR) FROM j LEFT JOIN station ON j.station_id=station.station_id WHERE station.station_id IS NULL
      UNION ALL SELECT 'unit', TRIM(unit_raw) FROM stop WHERE TRIM(unit_raw)<>'' AND TRIM(unit_raw) NOT IN (SELECT CAST(truck_id AS VARCHAR) FROM assignment WHERE truck_id IS NOT NULL))
    SELECT kind, miss, COUNT(*) AS n FROM m GROUP BY 1,2""",
)
def batch_misses(stop, assignment, driver, station):
    """Cards whose number ends in 0 are off the roster; express rows name the units of the stops."""
    own = N.resolve_trucks(stop, assignment).select("card_id", "station_id", "truck_id")
    trucks = assignment.where("truck_id is not null").select(F.col("truck_id").cast("string").alias("unit")).distinct()
    cards = driver.where("driver_id % 10 <> 0").select(F.col("driver_id").alias("card_id"))
    return joins.batch_misses(own, stop.select("unit_raw"), cards, trucks, station)


@query(
    "Q2_reresolved", "stop assignment",
    """WITH j AS (SELECT stop_id, s.truck_id AS t1, a.truck_id AS t2 FROM stop s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31'))
    SELECT stop_id, 'truck_id' AS field, CAST(t1 AS VARCHAR) AS before, CAST(t2 AS VARCHAR) AS after FROM j WHERE t1 IS DISTINCT FROM t2""",
)
def reresolved(stop, assignment):
    return sets.diff_snapshots(stop, N.resolve_trucks(stop, assignment), "stop_id", ["truck_id"])


#: A change of assignments: every fifth driver gives a truck back in the middle of 1997, every seventh had another one in 1995 and 1996.
AFTER = """SELECT driver_id, CASE WHEN driver_id % 7 = 0 AND valid_from = DATE '1995-01-01' THEN truck_id + 1 ELSE truck_id END AS truck_id, valid_from,
  CASE WHEN driver_id % 5 = 0 AND valid_from = DATE '1997-01-01' THEN DATE '1997-06-30' ELSE valid_to END AS valid_to FROM assignment"""


def _findings_sql(assignments: str, name: str) -> str:
    """Common table expressions: all findings, as `name`, of the stops with the trucks of `assignments`."""
    stops = f"stop_{name} AS (SELECT s.* REPLACE (a.truck_id AS truck_id) FROM stop s LEFT JOIN {assignments} a ON s.driver_id=a.driver_id AND day BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31'))"
    rest = re.sub(r"\bstop\b", f"stop_{name}", ALL.removeprefix("WITH ")).replace("audit", f"audit_{name}").replace("allf AS (", f"{name} AS MATERIALIZED (")
    return f"{stops}, {rest}"


def _after(assignment):
    return assignment.sparkSession.sql(AFTER.replace("FROM assignment", "FROM {assignment}"), assignment=assignment)


def _built(stop, line, published, assignment) -> str:
    folder = shared_folder(stop.sparkSession)
    reresolution.build(stop, line, published, assignment, folder)
    return folder


@query("Q2_findings_after", "stop line published assignment", f"WITH after AS ({AFTER}), {_findings_sql('after', 'a')} SELECT rule, subject_id, severity, detail FROM a")
def findings_after(stop, line, published, assignment):
    """What is stored once only the touched weeks were rebuilt; the twin rebuilds all."""
    folder = _built(stop, line, published, assignment)
    reresolution.reresolve(folder, line, published, assignment, _after(assignment), f"{folder}/report")
    return reresolution.stored(stop.sparkSession, folder)[1].select("rule", "subject_id", "severity", "detail")


@query(
    "Q3_preview_flags", "stop line published assignment",
    f"""WITH after AS ({AFTER}), {_findings_sql('assignment', 'b')}, {_findings_sql('after', 'a')}
    SELECT COALESCE(a.rule, b.rule) AS rule, COALESCE(a.subject_id, b.subject_id) AS subject_id, CASE WHEN a.rule IS NULL THEN 'cleared' WHEN b.rule IS NULL THEN 'appeared' ELSE 'changed' END AS change, COALESCE(a.severity, b.severity) AS severity,
    COALESCE(a.detail, b.detail) AS detail FROM a FULL JOIN b ON a.rule=b.rule AND a.subject_id=b.subject_id WHERE a.rule IS NULL OR b.rule IS NULL OR a.severity<>b.severity OR a.detail<>b.detail""",
)
def preview_flags(stop, line, published, assignment):
    folder = _built(stop, line, published, assignment)
    return reresolution.preview(folder, line, published, assignment, _after(assignment))[1]


@query(
    "Q3_preview_moves", "stop line published assignment",
    f"""WITH after AS ({AFTER}) SELECT stop_id, b.truck_id AS before, a.truck_id AS after FROM stop s LEFT JOIN assignment b ON s.driver_id=b.driver_id AND day BETWEEN b.valid_from AND COALESCE(b.valid_to, DATE '9999-12-31')
    LEFT JOIN after a ON s.driver_id=a.driver_id AND day BETWEEN a.valid_from AND COALESCE(a.valid_to, DATE '9999-12-31') WHERE a.truck_id IS DISTINCT FROM b.truck_id""",
)
def preview_moves(stop, line, published, assignment):
    folder = _built(stop, line, published, assignment)
    return reresolution.preview(folder, line, published, assignment, _after(assignment))[0]
