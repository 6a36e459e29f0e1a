"""The whole filtered listing: every filter, the joins with users' state, scores and companies, the orders and the shown fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions import dates, fields, geo, places
from boardlake.functions.enrich import DEMANDS, with_line
from boardlake.functions.hiring import infer_geo
from boardlake.functions.industry import of_industry
from boardlake.functions.sources import infer_source
from boardlake.functions.text import like_text
from boardlake.operators import filters, joins
from boardlake.operators.matching import _SCORES, match_scores, resumes
from boardlake.registry import query
from boardlake.sources.postings import ACTIONS, NOW, POSTINGS, actions, postings

QUEUES = ("new", "shortlisted", "reviewed")


@dataclass
class Spec:
    """What a listing asks for; empty fields ask for nothing."""

    search: str = ""
    sources: list[str] = field(default_factory=list)
    compensation_types: list[str] = field(default_factory=list)
    pay_periods: list[str] = field(default_factory=list)
    pay_min: float | None = None
    pay_max: float | None = None
    unknown_pay: bool = True
    education: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    counties: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    remote: list[str] = field(default_factory=list)
    hide_no_date: bool = False
    include_applied: bool = True
    include_ignored: bool = False
    include_dead: bool = False
    include_stale_dated: bool = False
    review_queue: str = ""
    min_match_percent: float | None = None
    resume_key: str = "baker"
    sort: str = "recent"
    limit: int = 500
    offset: int = 0
    hours: int = 168

    def __post_init__(self) -> None:
        if self.review_queue and self.review_queue not in QUEUES:
            raise ValueError(f"review_queue must be one of: {', '.join(QUEUES)}")
        self.limit, self.offset = min(max(self.limit, 1), 2000), max(self.offset, 0)


#: What a user's saved preferences may fill in.
PREFERRED = ("search", "industries", "states", "counties", "countries", "regions", "remote")


def candidates(asked: dict, saved: dict, use_settings: bool = True, budget: int = 10) -> Spec:
    """The spec of a run of applications: what is asked for, else what is saved; as many rows as asked for, else as the budget has.

    Applied postings are left out unless they are asked for."""
    given = {k: v for k, v in asked.items() if v}
    if use_settings:
        given = {k: saved[k] for k in PREFERRED if saved.get(k)} | given
    return Spec(**{"include_applied": False, "limit": max(1, budget)} | given)


def pay_period(periods: list[str]) -> Column:
    """Normalised period in the set; rows without one fail."""
    return F.coalesce(fields.pay_period(F.col("pay_period")).isin(periods), F.lit(False))


def compensation_type(types: list[str]) -> Column:
    """Unknown is a value like others."""
    return fields.compensation_type(F.col("compensation_type")).isin(types)


def remote(modes: list[str]) -> Column:
    return F.lit("all" in modes) | geo.work_mode(F.coalesce("location", F.lit(""))).isin(modes)


def user_state(log: DataFrame) -> DataFrame:
    """posting_id, applied, ignored, review_state of a log of actions; a third of all actions on one posting add up beforehand."""
    named = F.create_map(*[F.lit(x) for kv in {"view": "viewed", "shortlist": "shortlisted", "ignore": "ignored", "apply": "viewed"}.items() for x in kv])
    return log.groupBy("posting_id").agg(
        F.max(F.col("action") == "apply").alias("applied"), F.max(F.col("action") == "ignore").alias("ignored"),
        F.max_by(named[F.col("action")], F.struct("acted", "event_id")).alias("review_state"),
    )


def list_postings(
    df: DataFrame, spec: Spec, state: DataFrame, scores: DataFrame, companies: DataFrame, blocked: DataFrame, now: int, fitted: DataFrame | None = None
) -> DataFrame:
    """A page of the listing.

    df are postings, state is user_state(), scores has posting_id, resume_key and match_percent,
    companies company_name and source (of several with one key the first by name and source
    counts), blocked company_name, fitted is a matcher() where industries are asked for. Filters on stored columns come first and reach the scan.
    """
    cutoff = now - dates.window_seconds(spec.hours)
    if spec.review_queue in ("shortlisted", "reviewed"):
        seen = F.lit(True)
    else:
        shown = ~F.col("hidden") | (F.coalesce(F.col("hidden_reason") == "outside_date_window", F.lit(False)) if spec.include_stale_dated else F.lit(False))
        seen = shown & (F.col("last_seen_epoch") >= cutoff)
    wanted = [seen, filters.search(spec.search)]
    if not spec.include_dead:
        wanted.append(F.coalesce("status", F.lit("unverified")) != "dead")
    if spec.compensation_types:
        wanted.append(compensation_type(spec.compensation_types))
    if spec.pay_min is not None or spec.pay_max is not None:
        wanted.append(filters.pay_range(spec.pay_min, spec.pay_max, spec.unknown_pay))
    if spec.pay_periods:
        wanted.append(pay_period(spec.pay_periods))
    if spec.education:
        wanted.append(filters.education(spec.education))
    if spec.remote:
        wanted.append(remote(spec.remote))
    rows = joins.without_blocked(df.filter(reduce(Column.__and__, wanted)), blocked)
    key = like_text(F.col("company_name"))
    named = companies.groupBy(key.alias("_company")).agg(F.min("source").alias("_source")).filter("_source is not null")
    rows = rows.withColumn("_key", key).join(named, F.col("_key") == F.col("_company"), "left").withColumn(
        "source", F.coalesce("_source", infer_source(F.col("job_posting_url")))
    ).drop("_key", "_company", "_source")
    if spec.sources:
        rows = rows.filter(F.col("source").isin(spec.sources))
    if spec.industries:
        met = of_industry(rows, "posting_id", "position_name", fitted).filter(F.col("industry").isin(spec.industries)).select("posting_id").distinct()
        rows = rows.join(met, "posting_id", "left_semi")
    asked = {
        "states": places.state_filters(spec.states), "counties": places.county_filters(spec.counties), "countries": places.country_filters(spec.countries), "regions": places.region_filters(spec.regions),
    }
    if any(asked.values()) or spec.cities:
        told = lambda c: F.struct(geo.entries(c).alias("entries"), infer_geo(c).alias("geo"))
        rows = geo.per_distinct(rows, "location", "_at", told)
        rows = rows.filter(places.in_place(F.col("location"), F.col("_at.entries"), F.col("_at.geo"), **asked))
        if spec.cities:
            rows = rows.filter(places.in_town(F.col("_at.entries"), places.city_filters(spec.cities)))
        rows = rows.drop("_at")
    rows = dates.classified(rows, now, spec.hours)
    if spec.hide_no_date:
        rows = rows.filter(fields.real_source_date(F.col("posting_date"), F.coalesce("source", F.lit("")), F.col("first_seen_epoch"), F.col("last_seen_epoch"), now))
    rows = rows.join(state, "posting_id", "left").withColumns(
        {"applied": F.coalesce("applied", F.lit(False)), "ignored": F.coalesce("ignored", F.lit(False)), "review_state": F.coalesce("review_state", F.lit("unseen"))}
    )
    if not spec.include_applied:
        rows = rows.filter("not applied")
    if not spec.include_ignored and spec.review_queue != "reviewed":
        rows = rows.filter("not ignored")
    queue = {
        "": F.lit(True), "new": (F.col("review_state") == "unseen") & F.col("freshness").isin("confirmed_recent", "newly_discovered"),
        "shortlisted": F.col("review_state") == "shortlisted", "reviewed": F.col("review_state").isin("viewed", "ignored") | F.col("ignored"),
    }[spec.review_queue]
    one = scores.filter(F.col("resume_key") == spec.resume_key).select("posting_id", "match_percent", F.lit(True).alias("_scored"))
    rows = rows.filter(queue).join(one, "posting_id", "left").withColumn("match_status", match_status(F.col("_scored"), F.col("match_percent"), F.col("job_description")))
    if spec.min_match_percent is not None:
        rows = rows.filter(F.coalesce("match_percent", F.lit(-1.0)) >= spec.min_match_percent)
    page = rows.orderBy(*joins.order(spec.sort))
    page = (page.offset(spec.offset) if spec.offset else page).limit(spec.limit)
    return page.withColumn("date_label", dates.date_label(F.col("posting_date"), F.col("first_seen_epoch"), F.col("last_seen_epoch"))).drop("_scored")


def match_status(scored: Column, percent: Column, description: Column) -> Column:
    """pending, no_description, no_requirements_detected or scored."""
    described = F.trim(F.coalesce(description, F.lit(""))) != ""
    return (
        F.when(scored.isNull() & described, "pending").when(scored.isNull(), "no_description").when(percent.isNull(), "no_requirements_detected").otherwise("scored")
    )


def with_totals(matched: DataFrame, order: list[Column], limit: int, now: int, window: int) -> DataFrame:
    """The first rows of a result, and on each of them how many there are in all, visible, with unknown pay, and shown."""
    totals = matched.agg(
        F.count("*").alias("total"), F.count_if(filters.visibility("visible", now, window)).alias("visible"),
        F.count_if(F.col("pay_min").isNull() & F.col("pay_max").isNull()).alias("pay_unknown"),
    )
    page = matched.orderBy(*order).limit(limit)
    return page.crossJoin(F.broadcast(totals)).withColumn("shown", F.least(F.lit(limit), F.col("total")))  # totals are one row


_COMPANIES = [("company src1", "greenhouse"), ("Company  SRC2", "lever"), ("company src2", "workday"), ("Company src3", None)]


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """State, scores, companies and blocked companies of the registered queries; scores of every posting that isn't divisible by 7."""
    df = postings(spark, sf_dir)
    told = match_scores(with_line(df, DEMANDS), resumes(spark)).filter("posting_id % 7 <> 0").select("posting_id", "resume_key", "match_percent")
    companies = spark.createDataFrame(_COMPANIES, "company_name string, source string")
    return user_state(actions(spark, sf_dir)), told, companies, joins._blocked(spark)


_LISTED = f"""{POSTINGS}, {ACTIONS}, {_SCORES}, {joins._BLOCKED},
st AS (SELECT posting_id, bool_or(action = 'apply') AS applied, bool_or(action = 'ignore') AS ignored, arg_max(CASE action WHEN 'shortlist' THEN 'shortlisted' WHEN 'ignore' THEN 'ignored' ELSE 'viewed' END, (acted, event_id)) AS review_state
FROM actions GROUP BY 1),
sc AS (SELECT posting_id, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total END AS match_percent, true AS scored FROM postings JOIN a ON posting_id % 3 = r WHERE resume_key = 'baker' AND posting_id % 7 <> 0),
dd AS (SELECT *, CASE WHEN t = 'yesterday' THEN 1706659200 - 86400 WHEN regexp_matches(t, '^[0-9]+ days ago$') THEN 1706659200 - regexp_extract(t, '([0-9]+)', 1)::BIGINT * 86400
ELSE epoch(try_strptime(t, '%Y-%m-%d'))::BIGINT END AS e FROM (SELECT *, lower(trim(posting_date)) AS t FROM postings)),
cl AS (SELECT dd.* EXCLUDE (source), CASE lower(trim(company_name)) WHEN 'company src1' THEN 'greenhouse' WHEN 'company src2' THEN 'lever' END AS source,
CASE WHEN status = 'dead' OR coalesce(hidden_reason = 'delisted', false) THEN 'delisted' WHEN e >= 1706659200 - 604800 AND e <= 1706659200 + 86400 THEN 'confirmed_recent' WHEN e <= 1706659200 + 86400 THEN 'stale_live'
WHEN first_seen_epoch BETWEEN 1706659200 - 604800 AND 1706659260 THEN 'newly_discovered' ELSE 'unknown_date' END AS freshness,
coalesce(applied, false) AS applied, coalesce(ignored, false) AS ignored, coalesce(review_state, 'unseen') AS review_state, match_percent,
CASE WHEN scored IS NULL THEN CASE WHEN trim(coalesce(job_description, '')) <> '' THEN 'pending' ELSE 'no_description' END WHEN match_percent IS NULL THEN 'no_requirements_detected' ELSE 'scored' END AS match_status,
CASE WHEN trim(posting_date) <> '' THEN trim(posting_date) ELSE 'Source date unavailable (synced to database on ' || strftime(make_timestamp(first_seen_epoch * 1000000), '%Y-%m-%d') || ')' END AS date_label
FROM dd LEFT JOIN st USING (posting_id) LEFT JOIN sc USING (posting_id) WHERE lower(trim(company_name)) NOT IN (SELECT key FROM blocked))"""
_SHOWN = "posting_id, company_name, position_name, source, freshness, applied, review_state, match_percent, match_status, date_label"


@query(
    f"""WITH {_LISTED} SELECT {_SHOWN} FROM cl WHERE (NOT hidden OR coalesce(hidden_reason = 'outside_date_window', false)) AND last_seen_epoch >= 1706659200 - 604800 AND status <> 'dead'
AND (lower(company_name) LIKE '%src%' OR lower(position_name) LIKE '%src%' OR lower(location) LIKE '%src%') AND (lower(company_name) LIKE '%e%' OR lower(position_name) LIKE '%e%' OR lower(location) LIKE '%e%')
AND coalesce(compensation_type, 'unknown') IN ('salary', 'hourly', 'unknown') AND (pay_max IS NULL OR pay_max >= 60000) AND NOT ignored AND coalesce(match_percent, -1) >= -1
ORDER BY match_percent DESC NULLS LAST, last_seen_epoch DESC, posting_id DESC LIMIT 300"""
)
def q_list_postings(spark, sf_dir) -> DataFrame:
    """Best matches first, stale but open ones too."""
    spec = Spec(search="src e", compensation_types=["salary", "hourly", "unknown"], pay_min=60_000, include_stale_dated=True, min_match_percent=-1, sort="match_desc", limit=300)
    return list_postings(postings(spark, sf_dir), spec, *_sides(spark, sf_dir), NOW).select(*_SHOWN.split(", "))


@query(
    f"""WITH {_LISTED}, l(location) AS (VALUES ('Seattle, WA'), ('Kent, WA'), ('US-WA-Redmond'), ('Portland, OR 97201'), ('Hybrid - Boston, MA'), ('Florence Kentucky'), ('Denver, CO; Austin, TX'), ('Washington, DC'), ('Chicago, IL or Remote'))
SELECT {_SHOWN} FROM cl JOIN l USING (location) WHERE NOT hidden AND last_seen_epoch >= 1706659200 - 604800 AND status <> 'dead' AND NOT regexp_matches(location, '(?i)remote') AND NOT applied AND NOT ignored
AND pay_period = 'year' AND review_state = 'unseen' AND freshness IN ('confirmed_recent', 'newly_discovered') ORDER BY lower(company_name), posting_id LIMIT 100"""
)
def q_list_queue(spark, sf_dir) -> DataFrame:
    """The queue of new postings with yearly pay at places in the country, not remote."""
    spec = Spec(pay_periods=["year"], countries=["usa"], states=["WA", "Oregon", "ma", "KY", "CO", "Texas", "DC", "IL"], regions=["amer"], remote=["hybrid", "non_remote"], include_applied=False, review_queue="new", sort="company_asc", limit=100)
    return list_postings(postings(spark, sf_dir), spec, *_sides(spark, sf_dir), NOW).select(*_SHOWN.split(", "))


@query(
    f"""WITH {_LISTED} SELECT {_SHOWN} FROM cl WHERE status <> 'dead' AND (review_state IN ('viewed', 'ignored') OR ignored) AND source IN ('greenhouse', 'lever') AND e IS NOT NULL
AND list_has_any(string_split(education_levels, ','), ['masters', 'high_school']) ORDER BY first_seen_epoch DESC, posting_id DESC LIMIT 100 OFFSET 1"""
)
def q_list_reviewed(spark, sf_dir) -> DataFrame:
    """What was reviewed, of two boards and with a real date, whether still visible or not."""
    spec = Spec(sources=["greenhouse", "lever"], hide_no_date=True, review_queue="reviewed", education=["masters", "high_school"], sort="first_seen", limit=100, offset=1)
    return list_postings(postings(spark, sf_dir), spec, *_sides(spark, sf_dir), NOW).select(*_SHOWN.split(", "))


@query(
    f"""WITH {POSTINGS}, m AS (SELECT * FROM postings WHERE position_name LIKE '%red%' AND NOT regexp_matches(coalesce(location, ''), '(?i)remote')),
t AS (SELECT count(*) AS total, count(*) FILTER (NOT hidden AND last_seen_epoch >= 1706659200 - 604800) AS visible, count(*) FILTER (pay_min IS NULL AND pay_max IS NULL) AS pay_unknown FROM m)
SELECT posting_id, pay_max, total, visible, pay_unknown, least(20, total) AS shown FROM (SELECT * FROM m ORDER BY pay_max DESC NULLS LAST, posting_id DESC LIMIT 20), t"""
)
def q_query_postings(spark, sf_dir) -> DataFrame:
    matched = postings(spark, sf_dir).filter(filters.any_of("position_name", ["red"]) & filters.none_of("location", ["remote"]))
    return with_totals(matched, joins.top_k("pay_max"), 20, NOW, 604_800).select("posting_id", "pay_max", "total", "visible", "pay_unknown", F.col("shown").cast("long").alias("shown"))


@query(
    f"""WITH {POSTINGS} SELECT count(*) FILTER (pay_period = 'hour') AS by_hour, count(*) FILTER (pay_period IN ('hour', 'year')) AS either, count(*) FILTER (coalesce(compensation_type, 'unknown') = 'unknown') AS unknown,
count(*) FILTER (compensation_type IN ('hourly', 'both')) AS paid_by_hour, count(*) FILTER (regexp_matches(location, '(?i)hybrid')) AS hybrid,
count(*) FILTER (coalesce(NOT regexp_matches(location, '(?i)hybrid|remote|work from home|wfh'), true)) AS on_site, count(*) AS every_mode FROM postings"""
)
def q_pay_kinds(spark, sf_dir) -> DataFrame:
    """How many postings pass the filters on pay period, compensation type and work mode."""
    return postings(spark, sf_dir).agg(
        F.count_if(pay_period(["hour"])).alias("by_hour"), F.count_if(pay_period(["hour", "year"])).alias("either"), F.count_if(compensation_type(["unknown"])).alias("unknown"),
        F.count_if(compensation_type(["hourly", "both"])).alias("paid_by_hour"), F.count_if(remote(["hybrid"])).alias("hybrid"), F.count_if(remote(["non_remote"])).alias("on_site"),
        F.count_if(remote(["all"])).alias("every_mode"),
    )
