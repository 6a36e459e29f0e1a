"""Merges of snapshots and reducers of action logs: (current, incoming, now) to the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlake.constants import DAY, RETENTION_DAYS
from boardlake.functions.dates import window_seconds, within_window
from boardlake.functions.fields import location_from_url
from boardlake.registry import query
from boardlake.sources.postings import ACTIONS, NOW, POSTINGS, actions, postings

KEY = "job_posting_url"


def upsert(current: DataFrame, incoming: DataFrame, seen: int) -> DataFrame:
    """Incoming rows by URL, the last of a batch winning (highest batch_order). New rows are inserted;
    known ones take over what they bring, keep when they were first seen and come back into view.
    The location follows the raw location, and pay changes only with a description."""
    last = incoming.groupBy(KEY).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != KEY]), "batch_order").alias("i"))
    joined = current.select(F.struct(*current.columns).alias("c"), F.col(KEY).alias("_key")).join(
        last.withColumnRenamed(KEY, "_new"), F.col("_key") == F.col("_new"), "full"
    )
    met, told = F.col("_new").isNotNull(), F.col("i.job_description").isNotNull()
    pay = lambda c: F.when(met & (told | F.col("_key").isNull()), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    return joined.select(
        F.coalesce("_new", "_key").alias(KEY),
        F.coalesce("i.position_name", "c.position_name").alias("position_name"),
        F.coalesce("i.location", "c.location").alias("location"),
        F.coalesce("i.job_description", "c.job_description").alias("job_description"),
        pay("pay_min"), pay("pay_max"),
        F.coalesce("c.first_seen_epoch", F.lit(seen)).alias("first_seen_epoch"),
        F.when(met, F.lit(seen)).otherwise(F.col("c.last_seen_epoch")).alias("last_seen_epoch"),
        F.when(met, F.lit(False)).otherwise(F.col("c.hidden")).alias("hidden"),
        F.when(~met, F.col("c.hidden_reason")).alias("hidden_reason"),
        F.when(~met, F.col("c.hidden_at_epoch")).alias("hidden_at_epoch"),
    )


def prune(current: DataFrame, now: int, window: int) -> DataFrame:
    """Visible postings not seen within the window are hidden as delisted and lose their description."""
    out = ~F.col("hidden") & (F.col("last_seen_epoch") < now - window)
    return current.withColumns(
        {
            "hidden": F.col("hidden") | out,
            "hidden_reason": F.when(out, "delisted").otherwise(F.col("hidden_reason")),
            "hidden_at_epoch": F.when(out, F.coalesce("hidden_at_epoch", F.lit(now))).otherwise(F.col("hidden_at_epoch")),
            "job_description": F.when(~out, F.col("job_description")),
        }
    )


def delete_expired(current: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    return current.filter(~(F.col("hidden") & (F.coalesce("hidden_at_epoch", F.lit(now)) < now - days * DAY)))


_CURRENT = "cur AS (SELECT * FROM postings)"
_INCOMING = """inc AS (SELECT * FROM (SELECT job_posting_url || CASE WHEN posting_id % 2 = 0 THEN '' ELSE '/again' END AS job_posting_url, position_name || ' II' AS position_name, CASE WHEN posting_id % 4 <> 0 THEN location END AS location,
CASE WHEN posting_id % 5 <> 0 THEN job_description END AS job_description, pay_min + 1 AS pay_min, pay_max + 1 AS pay_max FROM postings))"""
_MERGED = """nxt AS (SELECT coalesce(i.job_posting_url, c.job_posting_url) AS job_posting_url, coalesce(i.position_name, c.position_name) AS position_name,
coalesce(i.location, c.location) AS location, coalesce(i.job_description, c.job_description) AS job_description,
CASE WHEN i.job_posting_url IS NOT NULL AND (i.job_description IS NOT NULL OR c.job_posting_url IS NULL) THEN i.pay_min ELSE c.pay_min END AS pay_min,
CASE WHEN i.job_posting_url IS NOT NULL AND (i.job_description IS NOT NULL OR c.job_posting_url IS NULL) THEN i.pay_max ELSE c.pay_max END AS pay_max,
coalesce(c.first_seen_epoch, 1706659200) AS first_seen_epoch, CASE WHEN i.job_posting_url IS NOT NULL THEN 1706659200 ELSE c.last_seen_epoch END AS last_seen_epoch,
CASE WHEN i.job_posting_url IS NOT NULL THEN false ELSE c.hidden END AS hidden, CASE WHEN i.job_posting_url IS NULL THEN c.hidden_reason END AS hidden_reason,
CASE WHEN i.job_posting_url IS NULL THEN c.hidden_at_epoch END AS hidden_at_epoch FROM cur c FULL JOIN inc i USING (job_posting_url))"""


def _next(spark, sf_dir) -> DataFrame:
    all_ = postings(spark, sf_dir)
    url = F.concat(KEY, F.when(F.col("posting_id") % 2 == 0, "").otherwise("/again"))  # half of the incoming ones are new
    one = all_.select(
        url.alias(KEY), F.concat("position_name", F.lit(" II")).alias("position_name"), F.when(F.col("posting_id") % 4 != 0, F.col("location")).alias("location"),
        F.when(F.col("posting_id") % 5 != 0, F.col("job_description")).alias("job_description"), (F.col("pay_min") + 1).alias("pay_min"),
        (F.col("pay_max") + 1).alias("pay_max"), F.lit(2).alias("batch_order"),
    )
    earlier = one.withColumns({"position_name": F.lit("overtaken"), "batch_order": F.lit(1)})
    return upsert(all_, one.unionByName(earlier), NOW)


@query(f"WITH {POSTINGS}, {_CURRENT}, {_INCOMING}, {_MERGED} SELECT job_posting_url, position_name, location, md5(job_description) AS description_md5, pay_min, pay_max, first_seen_epoch, last_seen_epoch::BIGINT AS last_seen_epoch, hidden, hidden_reason, hidden_at_epoch FROM nxt")
def m_upsert(spark, sf_dir) -> DataFrame:
    return _next(spark, sf_dir).withColumn("description_md5", F.md5("job_description")).drop("job_description")


@query(
    f"""WITH {POSTINGS}, {_CURRENT}, {_INCOMING}, {_MERGED}, p AS (SELECT *, NOT hidden AND last_seen_epoch < 1706659200 - 604800 AS gone FROM nxt),
q AS (SELECT CASE WHEN gone THEN 'delisted' ELSE hidden_reason END AS reason, hidden OR gone AS hidden, CASE WHEN gone THEN coalesce(hidden_at_epoch, 1706659200) ELSE hidden_at_epoch END AS hid,
NOT gone AND job_description IS NOT NULL AS described FROM p)
SELECT reason, count(*) AS n, count(*) FILTER (described) AS described FROM q WHERE NOT (hidden AND coalesce(hid, 1706659200) < 1706659200 - 30 * 86400) GROUP BY 1"""
)
def m_sync_pass(spark, sf_dir) -> DataFrame:
    """Upsert, prune and delete in turn, summed up by reason."""
    after = delete_expired(prune(_next(spark, sf_dir), NOW, 604_800), NOW)
    return after.groupBy(F.col("hidden_reason").alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("job_description").isNotNull()).alias("described"))


def resolved(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming with its location: its own, else that of its address, else that of the stored map known (job_posting_url, location)."""
    stored = known.groupBy(F.col(KEY).alias("_url")).agg(F.max("location").alias("_known"))
    place = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = incoming.join(stored, F.col(KEY) == F.col("_url"), "left")
    return found.withColumn("location", F.coalesce(place(F.col("location")), location_from_url(F.col(KEY)), place(F.col("_known")))).drop("_url", "_known")


def next_map(known: DataFrame, incoming: DataFrame, active: DataFrame) -> DataFrame:
    """The map of places by address after a pass: what the pass resolved replaces what was stored, and addresses that are no longer active go."""
    told = incoming.filter("location is not null").groupBy(KEY).agg(F.max_by("location", "batch_order").alias("location"))
    kept = known.join(told.select(KEY), KEY, "left_anti").select(KEY, "location")
    return kept.unionByName(told).join(active.select(KEY).distinct(), KEY, "left_semi")


def sync_pass(current: DataFrame, incoming: DataFrame, known: DataFrame, now: int, hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: postings that are too long unseen are hidden, incoming rows outside the date window are left out, the others get
    their place and are merged, and what is long hidden goes. Returns the next snapshot, the next map of places and a row of counts.
    """
    window = window_seconds(hours)
    before = prune(current, now, window)
    gated = incoming.withColumn("_in", within_window(F.col("posting_date"), now, hours))
    taken = resolved(gated.filter("_in").drop("_in", "posting_date"), known)
    merged = prune(upsert(before, taken, now), now, window)
    after = delete_expired(merged, now)
    urls, had = taken.select(KEY).distinct(), current.select(F.col(KEY).alias("_had")).distinct()
    met = urls.join(had, F.col(KEY) == F.col("_had"), "left")
    parts = (
        gated.agg(F.count_if(~F.col("_in")).alias("excluded")),
        met.agg(F.count("*").alias("stored"), F.count_if(F.col("_had").isNull()).alias("new"), F.count_if(F.col("_had").isNotNull()).alias("refreshed")),
        current.agg(F.count_if(~F.col("hidden") & (F.col("last_seen_epoch") < now - window)).alias("pruned")),
        merged.agg((F.count("*") - F.count_if(~(F.col("hidden") & (F.coalesce("hidden_at_epoch", F.lit(now)) < now - RETENTION_DAYS * DAY)))).alias("deleted")),
    )
    summary = reduce(lambda x, y: x.crossJoin(y), parts)  # one row each
    return after, next_map(known, taken, after.filter(~F.col("hidden"))), summary


_PASS_IN = """inc AS (SELECT posting_id, CASE posting_id % 3 WHEN 0 THEN 'https://x.example.com/en/job/Town--' || CAST(posting_id % 50 AS VARCHAR) || '-Hall/' || CAST(posting_id AS VARCHAR) ELSE job_posting_url END AS job_posting_url,
CASE WHEN posting_id % 2 = 0 THEN location END AS location, posting_date FROM postings)"""
_IN_WINDOW = """trim(posting_date) = '' OR posting_date = 'yesterday' OR posting_id % 6 = 1 AND posting_id % 20 <= 7 OR posting_id % 6 = 0 AND '2024-01-' || lpad(CAST(posting_id % 28 + 1 AS VARCHAR), 2, '0') >= '2024-01-24'"""
_PLACED = f"""taken AS (SELECT posting_id, job_posting_url, coalesce(nullif(trim(location), ''), CASE WHEN posting_id % 3 = 0 THEN 'Town- ' || CAST(posting_id % 50 AS VARCHAR) || ' Hall' END,
CASE WHEN posting_id % 5 = 0 THEN 'Known ' || CAST(posting_id % 7 AS VARCHAR) END) AS location FROM inc WHERE {_IN_WINDOW})"""


def _pass(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    all_ = postings(spark, sf_dir)
    rows = all_.withColumns(
        {
            KEY: F.when(F.col("posting_id") % 3 == 0, F.concat(F.lit("https://x.example.com/en/job/Town--"), F.col("posting_id") % 50, F.lit("-Hall/"), "posting_id")).otherwise(F.col(KEY)),
            "location": F.when(F.col("posting_id") % 2 == 0, F.col("location")), "batch_order": F.lit(1),
        }
    ).select(KEY, "posting_date", "position_name", "location", "job_description", "pay_min", "pay_max", "batch_order", "posting_id")
    known = rows.filter("posting_id % 5 = 0").select(KEY, F.concat(F.lit("Known "), F.col("posting_id") % 7).alias("location"))
    return sync_pass(all_, rows.drop("posting_id"), known, NOW, 168)


@query(f"WITH {POSTINGS}, {_PASS_IN}, {_PLACED} SELECT job_posting_url, location FROM taken WHERE location IS NOT NULL UNION ALL SELECT job_posting_url, 'Known ' || CAST(posting_id % 7 AS VARCHAR) FROM inc JOIN postings USING (posting_id, job_posting_url) WHERE posting_id % 5 = 0 AND NOT ({_IN_WINDOW.replace('posting_date', 'inc.posting_date')}) AND NOT hidden AND last_seen_epoch >= 1706659200 - 604800")
def m_location_map(spark, sf_dir) -> DataFrame:
    """The map of places after a pass: own places, those of addresses, stored ones; of postings that are still active."""
    return _pass(spark, sf_dir)[1]


@query(
    f"""WITH {POSTINGS}, {_PASS_IN}, {_PLACED}, m AS (SELECT taken.job_posting_url, p.job_posting_url IS NOT NULL AS had FROM taken LEFT JOIN postings p USING (job_posting_url)),
a AS (SELECT *, NOT hidden AND last_seen_epoch < 1706659200 - 604800 AS gone FROM postings)
SELECT (SELECT count(*) FROM inc) - (SELECT count(*) FROM taken) AS excluded, (SELECT count(*) FROM m) AS stored, (SELECT count(*) FROM m WHERE NOT had) AS new, (SELECT count(*) FROM m WHERE had) AS refreshed,
(SELECT count(*) FROM a WHERE gone) AS pruned, (SELECT count(*) FROM a WHERE (hidden OR gone) AND coalesce(hidden_at_epoch, 1706659200) < 1706659200 - 30 * 86400 AND job_posting_url NOT IN (SELECT job_posting_url FROM taken)) AS deleted"""
)
def m_sync_summary(spark, sf_dir) -> DataFrame:
    """Counts of a pass."""
    return _pass(spark, sf_dir)[2]


def review_state(log: DataFrame) -> DataFrame:
    """State of each posting from its log: last action, first time of each kind, when the state last changed."""
    of = Window.partitionBy("posting_id").orderBy("acted", "event_id")
    steps = log.withColumn("before", F.lag("action").over(of))
    when = lambda a: F.min(F.when(F.col("action") == a, F.col("acted")))
    return steps.groupBy("posting_id").agg(
        F.max_by("action", F.struct("acted", "event_id")).alias("state"),
        F.max(F.when(~F.col("before").eqNullSafe(F.col("action")), F.col("acted"))).alias("changed_at"),
        when("view").alias("first_viewed"), when("shortlist").alias("first_shortlisted"),
        F.count_if(~F.col("before").eqNullSafe(F.col("action"))).alias("transitions"),
    )


@query(
    f"""WITH {ACTIONS}, s AS (SELECT *, lag(action) OVER (PARTITION BY posting_id ORDER BY acted, event_id) AS before FROM actions)
SELECT posting_id, arg_max(action, (acted, event_id)) AS state, max(CASE WHEN before IS DISTINCT FROM action THEN acted END) AS changed_at,
min(CASE WHEN action = 'view' THEN acted END) AS first_viewed, min(CASE WHEN action = 'shortlist' THEN acted END) AS first_shortlisted,
count(*) FILTER (before IS DISTINCT FROM action) AS transitions FROM s GROUP BY 1"""
)
def m_review_state(spark, sf_dir) -> DataFrame:
    return review_state(actions(spark, sf_dir))


@query(
    """WITH o AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before, o_orderstatus AS status FROM o WHERE before IS DISTINCT FROM o_orderstatus"""
)
def m_status_history(spark, sf_dir) -> DataFrame:
    """Only real changes of status, the first included."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("before", before).filter(
        ~F.col("before").eqNullSafe(F.col("o_orderstatus"))
    ).select("o_custkey", "o_orderkey", "before", F.col("o_orderstatus").alias("status"))


@query(
    """SELECT c_custkey, greatest(coalesce(m, 0), 1000 * (c_custkey % 7))::BIGINT AS last_synced FROM customer
LEFT JOIN (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS m FROM events GROUP BY 1) ON user_id = c_custkey"""
)
def m_mark_synced(spark, sf_dir) -> DataFrame:
    marks = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.unix_timestamp("ts")).alias("m"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(marks, "c_custkey", "left").select(
        "c_custkey", F.greatest(F.coalesce("m", F.lit(0)), 1000 * (F.col("c_custkey") % 7)).alias("last_synced")
    )
