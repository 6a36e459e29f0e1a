"""Applications, error logs, companies and backlogs: keyed merges, reducers and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.constants import DAY
from boardlake.functions.dates import within_window
from boardlake.functions.geo import has_state, located
from boardlake.functions.geo import _ANSWERS as ANSWERS
from boardlake.functions.text import host, like_text
from boardlake.registry import query
from boardlake.sources.postings import ACTIONS, NOW, POSTINGS, actions, postings


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applied_state(log: DataFrame) -> DataFrame:
    """An application clears an earlier ignore; the state is viewed unless shortlisted before or after."""
    last = lambda a: F.max(F.when(F.col("action") == a, F.struct("acted", "event_id")))
    got = log.groupBy("posting_id").agg(last("apply").alias("a"), last("ignore").alias("i"), last("shortlist").alias("s"), last("view").alias("v"))
    ignored = F.col("i").isNotNull() & (F.col("a").isNull() | (F.col("i") > F.col("a")))
    return got.select(
        "posting_id", F.col("a").isNotNull().alias("applied"), F.col("a.acted").alias("applied_at"), ignored.alias("ignored"),
        F.when(ignored, "ignored").when(F.col("s").isNotNull(), "shortlisted").when(F.col("a").isNotNull() | F.col("v").isNotNull(), "viewed").alias("state"),
    )


@query(
    f"""WITH {ACTIONS}, g AS (SELECT posting_id, max(CASE WHEN action = 'apply' THEN (acted, event_id) END) AS a, max(CASE WHEN action = 'ignore' THEN (acted, event_id) END) AS i,
bool_or(action = 'shortlist') AS s, bool_or(action = 'view') AS v, max(CASE WHEN action = 'apply' THEN acted END) AS applied_at FROM actions GROUP BY 1),
h AS (SELECT *, i IS NOT NULL AND (a IS NULL OR i > a) AS ignored FROM g)
SELECT posting_id, a IS NOT NULL AS applied, applied_at, ignored, CASE WHEN ignored THEN 'ignored' WHEN s THEN 'shortlisted' WHEN a IS NOT NULL OR v THEN 'viewed' END AS state FROM h"""
)
def m_applied_state(spark, sf_dir) -> DataFrame:
    return applied_state(actions(spark, sf_dir))


def merge_by_key(target: DataFrame, source: DataFrame, key: list[str], first_id: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of source that target lacks, with new ids, and the map of source ids to target's.

    Rows meet on key; one that target has is reused, one it lacks gets first_id + its own id, which
    needs no global numbering.
    """
    known = target.groupBy(*key).agg(F.min("id").alias("_target"))
    met = source.join(known, key, "left")
    ids = met.select(F.col("id").alias("source_id"), F.coalesce("_target", first_id + F.col("id")).alias("target_id"), F.col("_target").isNull().alias("inserted"))
    return met.filter("_target is null").withColumn("id", first_id + F.col("id")).drop("_target"), ids


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS company, date_trunc('day', o_orderdate) AS day, o_orderstatus AS status FROM orders),
s AS (SELECT id, company, day, CASE WHEN id % 2 = 0 THEN status ELSE 'new' END AS status FROM a), k AS (SELECT company, day, status, min(id) AS target FROM a GROUP BY 1, 2, 3)
SELECT s.id AS source_id, coalesce(target, 1000000000 + s.id) AS target_id, target IS NULL AS inserted FROM s LEFT JOIN k ON k.company = s.company AND k.day = s.day AND k.status = s.status"""
)
def m_merge_applications(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"), F.date_trunc("day", "o_orderdate").alias("day"), F.col("o_orderstatus").alias("status")
    )
    other = rows.withColumn("status", F.when(F.col("id") % 2 == 0, F.col("status")).otherwise("new"))  # half of them differ from what is there
    return merge_by_key(rows, other, ["company", "day", "status"], F.lit(1_000_000_000))[1]


@query(
    """WITH o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS earlier,
lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS later FROM orders)
SELECT o_orderkey AS deleted, earlier AS points_to FROM o WHERE later IS NULL"""
)
def m_delete_application(spark, sf_dir) -> DataFrame:
    """Where the newest application of a company and status goes, its postings point to the next newest, or to none."""
    of = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    ranked = _table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(of).alias("_r"), F.lead("o_orderkey").over(of).alias("points_to"))
    return ranked.filter("_r = 1").select(F.col("o_orderkey").alias("deleted"), "points_to")


@query(
    f"""WITH {POSTINGS}, {ACTIONS}, n AS (SELECT posting_id, min(acted) AS applied_at FROM actions WHERE action = 'apply' GROUP BY 1)
SELECT posting_id, coalesce(nullif(trim(company_name), ''), regexp_extract(job_posting_url, '^https?://([^/:?#]+)', 1)) AS company, position_name, applied_at
FROM n JOIN postings USING (posting_id) WHERE posting_id % 4 <> 0"""
)
def m_create_applications(spark, sf_dir) -> DataFrame:
    """One application for each posting applied to that has none yet; the company by its name, else by the host."""
    new = actions(spark, sf_dir).filter("action = 'apply'").groupBy("posting_id").agg(F.min("acted").alias("applied_at"))
    have = _table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("posting_id"))
    company = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), host(F.col("job_posting_url")))
    return postings(spark, sf_dir).join(new, "posting_id").join(have, "posting_id", "left_anti").select("posting_id", company.alias("company"), "position_name", "applied_at")


@query(
    f"""WITH {POSTINGS} SELECT posting_id, CASE WHEN NOT hidden THEN NULL WHEN last_seen_epoch < 1706659200 - 604800 THEN 'delisted' ELSE 'outside_date_window' END AS hidden_reason FROM postings WHERE hidden"""
)
def m_hidden_reason(spark, sf_dir) -> DataFrame:
    """The reason of hidden rows that were stored without one, by when they were last seen."""
    reason = F.when(F.col("last_seen_epoch") < NOW - 604_800, "delisted").otherwise("outside_date_window")
    return postings(spark, sf_dir).filter("hidden").select("posting_id", reason.alias("hidden_reason"))


@query(
    f"""WITH {POSTINGS}, p AS (SELECT *, CASE WHEN posting_id % 3 = 0 THEN 1706659200 - posting_id * 86400 END AS fetched, CASE WHEN posting_id % 4 = 0 THEN 1706659200 - (posting_id % 9) * 3600 END AS failed FROM postings)
SELECT posting_id, last_seen_epoch FROM p WHERE NOT hidden AND (fetched IS NULL OR fetched < 1706659200 - 30 * 86400) AND (failed IS NULL OR failed < 1706659200 - 21600)
ORDER BY last_seen_epoch DESC, posting_id DESC LIMIT 100"""
)
def m_description_backlog(spark, sf_dir) -> DataFrame:
    """The newest hundred visible postings whose text was never read or is old, and didn't fail in the last six hours."""
    key = F.col("posting_id")
    rows = postings(spark, sf_dir).withColumns({"fetched": F.when(key % 3 == 0, NOW - key * DAY), "failed": F.when(key % 4 == 0, NOW - (key % 9) * 3600)})
    due = ~F.col("hidden") & F.coalesce(F.col("fetched") < NOW - 30 * DAY, F.lit(True)) & F.coalesce(F.col("failed") < NOW - 21_600, F.lit(True))
    return rows.filter(due).orderBy(F.desc("last_seen_epoch"), F.desc("posting_id")).limit(100).select("posting_id", "last_seen_epoch")


_EPOCH = """CASE WHEN t IN ('today', 'just now') THEN 1706659200 WHEN t = 'yesterday' THEN 1706659200 - 86400
WHEN regexp_matches(t, '^[0-9]+ days? ago$|^[0-9]+d$') THEN 1706659200 - regexp_extract(t, '([0-9]+)', 1)::BIGINT * 86400 ELSE epoch(try_strptime(t, '%Y-%m-%d'))::BIGINT END"""


@query(
    f"""WITH {POSTINGS}, d AS (SELECT *, {_EPOCH} AS e FROM (SELECT *, lower(trim(posting_date)) AS t FROM postings))
SELECT posting_id, hidden OR o AS hidden, CASE WHEN o THEN 'outside_date_window' ELSE hidden_reason END AS hidden_reason FROM
(SELECT *, NOT hidden AND t <> '' AND NOT coalesce(e >= 1706659200 - 604800, false) AS o FROM d)"""
)
def m_prune_outside_date(spark, sf_dir) -> DataFrame:
    """Visible postings whose date can be seen to lie outside the window are hidden."""
    out = ~F.col("hidden") & ~within_window(F.col("posting_date"), NOW, 168)
    return postings(spark, sf_dir).select(
        "posting_id", (F.col("hidden") | out).alias("hidden"), F.when(out, "outside_date_window").otherwise(F.col("hidden_reason")).alias("hidden_reason")
    )


@query(
    """SELECT event_id, event_type AS source, floor(epoch(ts))::BIGINT AS at, left(props, 200) AS context, event_id % 5 = 0 AS acknowledged FROM events
WHERE event_type IN ('error', 'signup') AND event_id % 5 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 200"""
)
def io_error_log(spark, sf_dir) -> DataFrame:
    """The newest 200 open entries of two sources, contexts cut to 200 characters."""
    ack = F.col("event_id") % 5 == 0
    return (
        _table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup") & ~ack).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
        .select("event_id", F.col("event_type").alias("source"), F.unix_timestamp("ts").alias("at"), F.substring("props", 1, 200).alias("context"), ack.alias("acknowledged"))
    )


@query(
    """WITH c AS (SELECT 'https://c' || c_custkey AS url, c_name AS name FROM customer), n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'https://c' ELSE 'https://n' END || c_custkey AS url, 'New ' || c_name AS name FROM customer)
SELECT coalesce(n.url, c.url) AS url, coalesce(n.name, c.name) AS name, CASE WHEN n.url IS NULL THEN 'kept' WHEN c.url IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM c FULL JOIN n ON c.url = n.url"""
)
def io_seed_upsert(spark, sf_dir) -> DataFrame:
    """Companies by URL, and whether each was inserted, updated or kept."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://c"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("name"))
    have = rows.select("url", F.col("name").alias("old"), F.lit(True).alias("had"))
    other = F.when(F.col("c_custkey") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "//c", "//n"))
    new = rows.select(other.alias("url"), F.concat(F.lit("New "), "name").alias("new"), F.lit(True).alias("came"))
    action = F.when(F.col("came").isNull(), "kept").when(F.col("had").isNull(), "inserted").otherwise("updated")
    return have.join(new, "url", "full").select("url", F.coalesce("new", "old").alias("name"), action.alias("action"))


@query(
    """WITH h AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, floor(epoch(min(o_orderdate)))::BIGINT AS first_denied_at FROM h WHERE o_orderstatus = 'F' AND before IS DISTINCT FROM 'F' GROUP BY 1"""
)
def ag_first_denied(spark, sf_dir) -> DataFrame:
    """When a company first turned to denied."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    turned = _table(spark, sf_dir, "orders").withColumn("_b", before).filter((F.col("o_orderstatus") == "F") & ~F.col("_b").eqNullSafe("F"))
    return turned.groupBy("o_custkey").agg(F.unix_timestamp(F.min("o_orderdate")).alias("first_denied_at"))


@query(
    f"""WITH {POSTINGS} SELECT (SELECT count(DISTINCT company_name) FROM postings) AS companies, (SELECT count(*) FROM postings WHERE NOT hidden AND last_seen_epoch >= 1706659200 - 604800) AS visible,
source, count(DISTINCT company_name) AS of_source FROM postings GROUP BY source"""
)
def ag_counts_status(spark, sf_dir) -> DataFrame:
    """Companies and visible postings in all, beside the companies of each source."""
    seen = postings(spark, sf_dir).groupBy("source", "company_name").agg(F.count_if(~F.col("hidden") & (F.col("last_seen_epoch") >= NOW - 604_800)).alias("v"))
    by = seen.groupBy("source").agg(F.count("*").alias("of_source"))
    whole = seen.agg(F.count_distinct("company_name").alias("companies"), F.sum("v").alias("visible"))
    return by.crossJoin(F.broadcast(whole)).select("companies", "visible", "source", "of_source")  # one row


@query(
    """WITH e AS (SELECT s_nationkey AS source, count(*) AS companies FROM supplier GROUP BY 1)
SELECT count(*) FILTER (source % 4 <> 0) AS enabled_sources, count(*) FILTER (source % 4 = 0) AS excluded_sources, sum(companies) FILTER (source % 4 <> 0)::BIGINT AS companies,
round(sum(companies * (source + 1) * 1.5) FILTER (source % 4 <> 0), 2)::DOUBLE AS seconds FROM e"""
)
def ag_scope_stats(spark, sf_dir) -> DataFrame:
    """Companies that a pass covers, and how long it may take by each source's estimate."""
    by = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("source")).agg(F.count("*").alias("companies"))
    on = F.col("source") % 4 != 0
    return by.agg(
        F.count_if(on).alias("enabled_sources"), F.count_if(~on).alias("excluded_sources"), F.sum(F.when(on, F.col("companies"))).alias("companies"),
        F.round(F.sum(F.when(on, F.col("companies") * (F.col("source") + 1) * 1.5)), 2).cast("double").alias("seconds"),
    )


@query(
    f"""WITH {POSTINGS}, d AS (SELECT source, CASE WHEN hidden THEN 'hidden' WHEN status = 'dead' THEN 'dead' WHEN coalesce(trim(posting_date), '') IN ('', 'n/a') THEN 'undated' ELSE 'kept' END AS outcome FROM postings)
SELECT source, outcome, count(*) AS n FROM d GROUP BY 1, 2"""
)
def ag_export_manifest(spark, sf_dir) -> DataFrame:
    """What became of the rows of each source in an extract."""
    undated = F.coalesce(F.trim("posting_date"), F.lit("")).isin("", "n/a")
    outcome = F.when(F.col("hidden"), "hidden").when(F.col("status") == "dead", "dead").when(undated, "undated").otherwise("kept")
    return postings(spark, sf_dir).groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POSTINGS}, {ACTIONS}, m AS (SELECT max(posting_id) AS top FROM postings), s AS (SELECT action AS resume_key, max(posting_id) AS last_id, count(DISTINCT posting_id) AS scored FROM actions GROUP BY 1)
SELECT resume_key, last_id, scored, round(last_id * 100.0::DOUBLE / top, 3) AS coverage, last_id >= top AS caught_up FROM s, m"""
)
def ag_scoring_status(spark, sf_dir) -> DataFrame:
    """How far each key's scoring has come."""
    done = actions(spark, sf_dir).groupBy(F.col("action").alias("resume_key")).agg(F.max("posting_id").alias("last_id"), F.count_distinct("posting_id").alias("scored"))
    top = postings(spark, sf_dir).agg(F.max("posting_id").alias("top"))
    both = done.crossJoin(F.broadcast(top))  # one row
    return both.select("resume_key", "last_id", "scored", F.round(F.col("last_id") * F.lit(100.0) / F.col("top"), 3).alias("coverage"), (F.col("last_id") >= F.col("top")).alias("caught_up"))


@query(
    f"""WITH {POSTINGS}, {ANSWERS}, c AS (SELECT DISTINCT country FROM postings JOIN answers USING (location) WHERE country IS NOT NULL)
SELECT country, row_number() OVER (ORDER BY coalesce(list_position(['US', 'CA', 'GB', 'DE'], country), 9), country) AS place FROM c"""
)
def ag_geo_options(spark, sf_dir) -> DataFrame:
    """Countries to choose from: usual ones in their order, then those found from A to Z."""
    found = located(spark, sf_dir).select(F.explode("entries.country").alias("country")).filter("country is not null").distinct()
    usual = F.array_position(F.array(*[F.lit(x) for x in ("US", "CA", "GB", "DE")]), F.col("country"))
    order = Window.orderBy(F.when(usual > 0, usual).otherwise(9), "country")  # one row for each country
    return found.withColumn("place", F.row_number().over(order).cast("long"))


@query(f"WITH {POSTINGS}, {ANSWERS} SELECT DISTINCT 'state' AS kind, state AS value FROM postings JOIN answers USING (location) WHERE state IS NOT NULL UNION ALL SELECT DISTINCT 'source', source FROM postings WHERE source IS NOT NULL")
def ag_filter_options(spark, sf_dir) -> DataFrame:
    """Distinct values that filters offer."""
    rows = located(spark, sf_dir)
    states = F.transform(F.col("entries.state"), lambda s: F.struct(F.lit("state").alias("kind"), s.alias("value")))
    source = F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")))
    return rows.select(F.inline(F.concat(states, source))).filter("value is not null").distinct()


@query(f"WITH {POSTINGS}, {ANSWERS} SELECT company_name, count(DISTINCT posting_id) AS n FROM postings JOIN answers USING (location) WHERE state IN ('WA', 'TX') GROUP BY 1")
def jn_states_semi(spark, sf_dir) -> DataFrame:
    """Companies of postings in two states; no row fans out, so no distinct is needed."""
    entries = F.col("entries")
    return located(spark, sf_dir).filter(has_state(entries, "WA") | has_state(entries, "TX")).groupBy("company_name").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT lower(trim(c_mktsegment)) AS key, min(c_custkey) AS company_id FROM customer GROUP BY 1)
SELECT o_orderkey, company_id, coalesce(nullif(s_name, ''), c_mktsegment) AS company FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN c ON c.key = lower(trim(c_mktsegment)) LEFT JOIN supplier ON s_suppkey = company_id"""
)
def jn_application_company(spark, sf_dir) -> DataFrame:
    """Each application's company: the first by id of equal name, shown by its stored name, else by the one given."""
    customers = _table(spark, sf_dir, "customer")
    first = customers.groupBy(like_text(F.col("c_mktsegment")).alias("key")).agg(F.min("c_custkey").alias("company_id"))
    named = first.join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("company_id") == F.col("s_suppkey"), "left")
    given = _table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return given.join(named, like_text(F.col("c_mktsegment")) == F.col("key"), "left").select(
        "o_orderkey", "company_id", F.coalesce(F.nullif("s_name", F.lit("")), "c_mktsegment").alias("company")
    )


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'https:') AS new_url FROM pages), m AS (SELECT new_url, min(page_id) AS first_ FROM p WHERE url <> new_url GROUP BY 1),
e AS (SELECT url FROM p WHERE url = new_url)
SELECT page_id, new_url AS url, url <> new_url AS moved FROM p LEFT JOIN m USING (new_url) WHERE url = new_url OR (new_url NOT IN (SELECT url FROM e) AND page_id = first_)"""
)
def jn_url_rewrite(spark, sf_dir) -> DataFrame:
    """Every page under its new URL, without those whose new URL another page has already or, of several that move there, a lower one."""
    new = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^http:", "https:")
    pages = _table(spark, sf_dir, "pages").select("page_id", new.alias("new_url"), (F.col("url") != new).alias("moved"))
    there = pages.filter("not moved").select("new_url")
    moving = pages.filter("moved").join(there, "new_url", "left_anti").groupBy("new_url").agg(F.min("page_id").alias("page_id")).withColumn("moved", F.lit(True))
    return pages.filter("not moved").unionByName(moving).select("page_id", F.col("new_url").alias("url"), "moved")


@query(
    f"""WITH {POSTINGS} SELECT posting_id, 'src' || regexp_extract(job_posting_url, '^https?://src([0-9]+)[.]', 1) AS source FROM postings
WHERE regexp_matches(job_posting_url, '^https?://src(1|2|3)[.]')"""
)
def q_source(spark, sf_dir) -> DataFrame:
    """Postings of three sources, told by the URL where the company names none."""
    rules = [(r"^https?://src1[.]", "src1"), (r"^https?://src2[.]", "src2"), (r"^https?://src3[.]", "src3")]
    source = F.coalesce(*[F.when(F.col("job_posting_url").rlike(p), name) for p, name in rules])
    return postings(spark, sf_dir).select("posting_id", source.alias("source")).filter("source is not null")


@query(
    f"""WITH {POSTINGS} SELECT posting_id, last_seen_epoch FROM postings WHERE lower(company_name) LIKE '%widget%' OR lower(position_name) LIKE '%widget%' OR lower(location) LIKE '%widget%'
ORDER BY last_seen_epoch DESC, posting_id DESC LIMIT 500"""
)
def q_find_text(spark, sf_dir) -> DataFrame:
    from boardlake.operators.filters import search

    return postings(spark, sf_dir).filter(search("widget")).orderBy(F.desc("last_seen_epoch"), F.desc("posting_id")).limit(500).select("posting_id", "last_seen_epoch")


@query(
    f"""WITH {POSTINGS}, {ACTIONS}, s AS (SELECT posting_id, arg_max(action, (acted, event_id)) AS state FROM actions GROUP BY 1)
SELECT CASE WHEN state = 'shortlist' THEN 'shortlisted' WHEN state IS NOT NULL THEN 'reviewed' WHEN first_seen_epoch >= 1706659200 - 604800 THEN 'new' ELSE 'other' END AS queue, count(*) AS n
FROM postings LEFT JOIN s USING (posting_id) WHERE NOT hidden GROUP BY 1"""
)
def q_review_queue(spark, sf_dir) -> DataFrame:
    """Visible postings by review queue; only untouched ones need be newly found."""
    state = actions(spark, sf_dir).groupBy("posting_id").agg(F.max_by("action", F.struct("acted", "event_id")).alias("state"))
    queue = F.when(F.col("state") == "shortlist", "shortlisted").when(F.col("state").isNotNull(), "reviewed").when(F.col("first_seen_epoch") >= NOW - 604_800, "new").otherwise("other")
    return postings(spark, sf_dir).filter("not hidden").join(state, "posting_id", "left").groupBy(queue.alias("queue")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POSTINGS}, k AS (SELECT DISTINCT user_id AS posting_id FROM events WHERE event_type = 'purchase')
SELECT posting_id, position_name, string_split(education_levels, ',')[1] AS level, status FROM postings SEMI JOIN k USING (posting_id)"""
)
def q_details(spark, sf_dir) -> DataFrame:
    """Full rows of a list of keys, arrays decoded."""
    keys = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("posting_id"))
    return postings(spark, sf_dir).join(keys, "posting_id", "left_semi").select(
        "posting_id", "position_name", F.try_element_at(F.split("education_levels", ","), F.lit(1)).alias("level"), "status"
    )
