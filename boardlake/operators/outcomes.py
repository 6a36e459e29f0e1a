"""What became of applications: counts, denials, how long they took and how well the postings had matched, by several groupings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import DAY
from boardlake.functions.fields import STATUSES, fit
from boardlake.registry import query

#: Older names of statuses.
LEGACY = {"rejected": "denied", "submitted": "applied"}
_SETS = ("status", "company", "fit", "outcome")


def status_bucket(raw: Column) -> Column:
    """Status of a stored text: one of the known ones, applied for a blank, an older name's, else other."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    older = F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv])
    return F.when(text == "", "applied").when(text.isin(*STATUSES), text).otherwise(F.coalesce(older[text], F.lit("other")))


def first_denied(history: DataFrame) -> DataFrame:
    """application_id, denied_at: the first real change to denied; the row that an application is seeded with is none."""
    real = F.col("previous_status").isNotNull() & (F.lower(F.trim("new_status")) == "denied")
    return history.filter(real).groupBy("application_id").agg(F.min("changed_at").alias("denied_at"))


def outcomes(applications: DataFrame, history: DataFrame) -> DataFrame:
    """grouping (all, status, company, fit or outcome), value, total, denied, denial_rate, mean_days, median_days, n_days, mean_match, n_match.

    applications has application_id, company, status, fit, applied_at and match_percent. All groupings are counted in one pass over
    them. Every known status has a row; companies without a denial and unknown fits have none; outcome parts denied from not denied.
    """
    told = applications.join(first_denied(history), "application_id", "left").withColumn("status", status_bucket(F.col("status")))
    denied = F.col("status") == "denied"
    days = F.when(denied & (F.col("denied_at") >= F.col("applied_at")) & (F.col("applied_at") > 0), (F.col("denied_at") - F.col("applied_at")) / DAY)
    rows = told.select(
        "status", F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Unknown company")).alias("company"), F.nullif(fit(F.col("fit")), F.lit("")).alias("fit"),
        F.when(denied, "denied").otherwise("not denied").alias("outcome"), denied.alias("_denied"), days.alias("_days"), "match_percent",
    )
    place = F.grouping_id(*_SETS)  # a bit for each column that is not grouped by, the first the highest
    counted = rows.groupingSets([(), *((c,) for c in _SETS)], *_SETS).agg(
        place.alias("_g"), F.count("*").alias("total"), F.count_if("_denied").alias("denied"), F.round(F.avg("_days"), 6).alias("mean_days"),
        F.round(F.median("_days"), 6).alias("median_days"), F.count("_days").alias("n_days"), F.round(F.avg("match_percent"), 6).alias("mean_match"), F.count("match_percent").alias("n_match"),
    )
    names = {15 - (8 >> i): c for i, c in enumerate(_SETS)}
    grouping = F.coalesce(*[F.when(F.col("_g") == g, c) for g, c in names.items()], F.lit("all"))
    value = F.coalesce(*[F.when(F.col("_g") == g, F.col(c)) for g, c in names.items()], F.when(F.col("_g") == 15, "all"))
    out = counted.select(
        grouping.alias("grouping"), value.alias("value"), "total", "denied", F.when(F.col("total") > 0, F.round(100.0 * F.col("denied") / F.col("total"), 6).cast("double")).otherwise(0.0).alias("denial_rate"),
        "mean_days", "median_days", "n_days", "mean_match", "n_match",
    ).filter("value is not null and (grouping <> 'company' or denied > 0)")
    known = applications.sparkSession.createDataFrame([("status", s) for s in STATUSES], "grouping string, value string")
    zero = {c: 0 for c in ("total", "denied", "denial_rate", "n_days", "n_match")}
    return out.filter("grouping <> 'status'").unionByName(known.unionByName(out.filter("grouping = 'status'").select("grouping", "value")).distinct().join(out, ["grouping", "value"], "left").fillna(zero))


_STATUS = "CASE o_orderkey % 8 WHEN 0 THEN 'denied' WHEN 1 THEN 'rejected' WHEN 2 THEN 'submitted' WHEN 3 THEN '' WHEN 4 THEN 'Odd' WHEN 5 THEN 'offer received' WHEN 6 THEN 'denied' ELSE 'interview scheduled' END"
_FIT = "CASE o_orderkey % 5 WHEN 0 THEN 'Good Fit' WHEN 1 THEN 'stretch' WHEN 2 THEN 'overqualified' WHEN 3 THEN '' ELSE 'none' END"
_MATCH = "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END"


@query(
    f"""WITH a AS (SELECT o_orderkey AS id, c_mktsegment AS company, {_STATUS} AS raw, {_FIT} AS fit, {_MATCH} AS m, o_orderkey % 11 = 0 AS seeded, o_orderkey % 40 AS half FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, CASE raw WHEN 'rejected' THEN 'denied' WHEN 'submitted' THEN 'applied' WHEN '' THEN 'applied' WHEN 'Odd' THEN 'other' ELSE raw END AS status FROM a),
c AS (SELECT *, status = 'denied' AS denied, CASE WHEN status = 'denied' THEN CASE WHEN seeded THEN half / 2.0 + 10 ELSE half / 2.0 END END AS days FROM b),
e AS (SELECT unnest([{{'g': 'all', 'v': 'all'}}, {{'g': 'status', 'v': status}}, {{'g': 'company', 'v': company}}, {{'g': 'fit', 'v': CASE WHEN fit IN ('', 'none') THEN NULL ELSE lower(fit) END}},
{{'g': 'outcome', 'v': CASE WHEN denied THEN 'denied' ELSE 'not denied' END}}]) AS k, denied, days, m FROM c),
s AS (SELECT k.g AS grouping, k.v AS value, count(*) AS total, count(*) FILTER (denied) AS denied, round(100.0 * count(*) FILTER (denied) / count(*), 6)::DOUBLE AS denial_rate, round(avg(days), 6)::DOUBLE AS mean_days,
round(median(days), 6)::DOUBLE AS median_days, count(days) AS n_days, round(avg(m), 6)::DOUBLE AS mean_match, count(m) AS n_match FROM e GROUP BY 1, 2)
SELECT * FROM s WHERE value IS NOT NULL AND (grouping <> 'company' OR denied > 0)
UNION ALL SELECT 'status', v, 0, 0, 0, NULL, NULL, 0, NULL, 0 FROM (VALUES ('awaiting response'), ('withdrawn')) z(v)"""
)
def ag_outcomes(spark, sf_dir) -> DataFrame:
    """Outcomes of all orders taken as applications, by status, company, fit and outcome in one job."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customers.select("c_custkey", F.col("c_mktsegment").alias("company")), F.col("o_custkey") == F.col("c_custkey"))
    applied = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    applications = rows.select(F.col("o_orderkey").alias("application_id"), "company", F.expr(_STATUS).alias("status"), F.expr(_FIT).alias("fit"), applied.alias("applied_at"), F.expr(_MATCH).alias("match_percent"))
    at = (applied + F.col("o_orderkey") % 40 * 43_200).alias("changed_at")
    change = lambda previous, when: orders.select(F.col("o_orderkey").alias("application_id"), previous.alias("previous_status"), F.lit(" Denied").alias("new_status"), when)
    seeded = F.when(F.col("o_orderkey") % 11 != 0, "applied")
    history = change(seeded, at).unionByName(change(F.lit("denied"), (applied + F.col("o_orderkey") % 40 * 43_200 + 10 * DAY).alias("changed_at")))
    return outcomes(applications, history)
