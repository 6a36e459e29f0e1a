"""What a visit to a posting's page tells: whether it is gone, its description, pay and wall; and what that does to the posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.enrich import html_to_text, pay_from_prose
from boardlake.functions.hiring import hiring_places
from boardlake.functions.text import ACCOUNT, GONE, requires_account, soft_not_found
from boardlake.registry import query
from boardlake.sources.pages import jsonld_posting
from boardlake.sources.postings import NOW, POSTINGS, postings

MOST_CHARS, LEAST_SHELL, LEAST_TOLD, LEAST_CONTAINER = 60_000, 200, 100, 200
#: Where boards put a description; what follows the opening tag is taken.
CONTAINERS = (
    r"""(?is)<div[^>]*class=["'][^"']*\biCIMS_JobContent\b[^"']*["'][^>]*>(.*)""",
    r"""(?is)<div[^>]*class=["'][^"']*\bjob-description\b[^"']*["'][^>]*>(.*)""",
    r"""(?is)<div[^>]*class=["'][^"']*\bjob__description\b[^"']*["'][^>]*>(.*)""",
    r"""(?is)<div[^>]*id=["']job-details["'][^>]*>(.*)""",
    r"""(?is)<div[^>]*id=["']content["'][^>]*>(.*)""",
    r"(?is)<main\b[^>]*>(.*?)</main>",
)
#: Words that tell how a job is paid and what it asks for.
HOURLY = r"\bhourly\b|\bper\s*hour\b|/\s*hr\b"
SALARY = r"\bsalary\b|\bannual(?:ly)?\b|\bper\s*year\b|/\s*year\b|\byearly\b"
LEVELS = {
    "high_school": r"\b(high school|ged)\b", "associate": r"\bassociate(?:s)?\b", "bachelor": r"\bbachelor(?:s)?\b|\bb\.?\s*s\.?\b|\bb\.?\s*a\.?\b",
    "master": r"\bmaster(?:s)?\b|\bmba\b|\bm\.?\s*s\.?\b|\bm\.?\s*a\.?\b", "doctorate": r"\b(doctorate|doctoral|phd|ph\.d\.)\b",
    "certificate": r"\b(certificate|certification|certified|diploma)\b",
}


def main_content(html: Column) -> Column:
    """Text of the first known container with 200 characters, else of the body without header, navigation and footer."""
    found = [F.when(html.rlike(p), html_to_text(F.regexp_extract(html, p, 1))) for p in CONTAINERS]
    enough = [F.when(F.length(t) >= LEAST_CONTAINER, t) for t in found]
    bare = html
    for tag in ("header", "nav", "footer"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    body = r"(?is)<body\b[^>]*>(.*)</body>"
    return F.coalesce(*enough, html_to_text(F.when(bare.rlike(body), F.regexp_extract(bare, body, 1)).otherwise(bare)))


def signals(description: Column) -> Column:
    """Struct of compensation_type (hourly, salary, both or unknown) and education_levels that a description names."""
    text = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " "), "(?i)&nbsp;", " "), r"\s+", " ")))
    hourly, salary = text.rlike(HOURLY), text.rlike(SALARY)
    levels = F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in LEVELS.items()]))
    return F.struct(
        F.when(hourly & salary, "both").when(hourly, "hourly").when(salary, "salary").otherwise("unknown").alias("compensation_type"), levels.alias("education_levels")
    )


def inspect_pages(visits: DataFrame) -> DataFrame:
    """visits (posting_id, http_status, html) with what each tells.

    ok is false for failures that say nothing (status 400 and above, but for 404 and 410, or none).
    dead: 404, 410, or a page without JSON-LD that says so. unverified: an empty shell.
    """
    answered = F.coalesce(F.col("http_status") < 400, F.lit(False))
    missing = F.coalesce(F.col("http_status").isin(404, 410), F.lit(False))
    rows = visits.withColumn("_ld", F.when(answered, jsonld_posting(F.col("html"))))
    told = html_to_text(F.get_json_object("_ld", "$.description"))
    rows = rows.withColumn("description", F.when(answered, F.substring(F.when(F.length(told) >= LEAST_TOLD, told).otherwise(main_content(F.col("html"))), 1, MOST_CHARS)))
    rows = rows.withColumn("dead", missing | (answered & F.col("_ld").isNull() & soft_not_found(F.col("description"))))
    alive = answered & ~F.col("dead")
    kept = F.when(alive, F.col("description"))
    return rows.withColumns(
        {
            "ok": answered | missing, "unverified": alive & F.col("_ld").isNull() & (F.length("description") < LEAST_SHELL),
            "requires_account": F.when(answered, requires_account(F.col("html"), F.col("description"))), "description": kept,
            "pay": F.when(alive, pay_from_prose(kept)), "hiring": F.when(alive, hiring_places(kept)),
        }
    ).drop("_ld", "html")


def apply_inspection(current: DataFrame, visits: DataFrame, now: int) -> DataFrame:
    """Postings after their visits: the dead keep the first time they were found so, the living lose it; a description replaces the
    stored one; pay is filled in only where there is none; a failure is noted and changes nothing else."""
    v = visits.select("posting_id", *[F.col(c).alias(f"_{c}") for c in ("ok", "dead", "unverified", "requires_account", "description", "pay")])
    living = F.coalesce(F.col("_ok") & ~F.col("_dead"), F.lit(False))
    dead = F.coalesce(F.col("_ok") & F.col("_dead"), F.lit(False))
    unpaid = ~(F.coalesce("pay_min", F.lit(0.0)) > 0) & ~(F.coalesce("pay_max", F.lit(0.0)) > 0)
    filled = lambda c: F.when(living & unpaid, F.coalesce(c, f"_pay.{c}")).otherwise(F.col(c))
    period = F.when(living & unpaid, F.coalesce(F.nullif(F.col("pay_period"), F.lit("")), F.col("_pay.pay_period"))).otherwise(F.col("pay_period"))
    return current.join(v, "posting_id", "left").select(
        "posting_id", F.when(dead, "dead").when(living & F.col("_unverified"), "unverified").when(living, "active").otherwise(F.col("status")).alias("status"),
        F.when(dead, F.coalesce("dead_since_epoch", F.lit(now))).when(~living, F.col("dead_since_epoch")).alias("dead_since_epoch"),
        F.when(living & (F.col("_description") != ""), F.col("_description")).otherwise(F.col("job_description")).alias("job_description"),
        F.when(dead | living, F.lit(now)).otherwise(F.col("description_fetched_at")).alias("description_fetched_at"),
        F.when(~F.col("_ok"), F.lit(now)).otherwise(F.col("fetch_failed_at")).alias("fetch_failed_at"),
        F.when(living, F.col("_requires_account")).otherwise(F.col("requires_account")).alias("requires_account"), filled("pay_min").alias("pay_min"), filled("pay_max").alias("pay_max"), period.alias("pay_period"),
    )


#: What is put into the pages, by page_id % 16.
SAID = [
    "", "This job posting was not found", "The position is no longer available.", "We are no longer accepting applications", "This listing has been closed", "position has been filled",
    "The page you are looking for could not be found", "Sorry, the job you want no longer exists", "Please sign in to apply", "Create an account to apply", "candidate portal", "<script>hCaptcha</script>",
    "Hourly pay, high school or GED", "Annual salary, a bachelor and an MBA", "yearly; certified; Ph.D. ", "per hour or per year, associates",
]
_AT = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"
#: The pages with those texts and pay: every third in a container, every fourth with a short body.
_MADE = rf"""made AS (SELECT page_id, CASE page_id % 9 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 410 ELSE 200 END AS http_status,
CASE WHEN page_id % 4 = 0 THEN '<html><body><nav>x</nav><p>' || ({_AT})[CAST(page_id % 16 AS INT) + 1] || '</p></body></html>'
WHEN page_id % 3 = 0 THEN '<html><body><div class="a job-description b"><p>Pay: $' || (40 + page_id % 50) || ',000 - $' || (95 + page_id % 4) || ',500 per year</p><p>' || ({_AT})[CAST(page_id % 16 AS INT) + 1] || '</p>' || html
ELSE '<p>' || ({_AT})[CAST(page_id % 16 AS INT) + 1] || '</p>' || html END AS html FROM pages)"""
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(H,
'(?is)<(?:script|style|noscript|svg)\b.*?</(?:script|style|noscript|svg)>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'), '<[^>]+>', ' ', 'g'),
'&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '(?i)&nbsp;|' || chr(160), ' ', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_READ = rf"""parts AS (SELECT *, regexp_extract(html, '(?is)<div[^>]*class=["''][^"'']*\bjob-description\b[^"'']*["''][^>]*>(.*)', 1) AS box,
regexp_replace(regexp_replace(regexp_replace(html, '(?is)<header\b.*?</header>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g') AS bare FROM made),
told AS (SELECT *, {_CLEAN.replace("H,", "box,", 1)} AS a, CASE WHEN regexp_matches(bare, '(?is)<body\b[^>]*>(.*)</body>') THEN regexp_extract(bare, '(?is)<body\b[^>]*>(.*)</body>', 1) ELSE bare END AS body FROM parts),
text AS (SELECT *, left(CASE WHEN length(a) >= 200 THEN a ELSE {_CLEAN.replace("H,", "body,", 1)} END, 60000) AS description FROM told)"""
_GONE, _ACCOUNT = ("(?i)" + "|".join(x).replace("'", "''") for x in (GONE, ACCOUNT))


def _made(spark, sf_dir) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("page_id") % 16).cast("int") + 1)
    p, text = F.col("page_id"), lambda c: c.cast("string")
    short = F.concat(F.lit("<html><body><nav>x</nav><p>"), said, F.lit("</p></body></html>"))
    boxed = F.concat(
        F.lit('<html><body><div class="a job-description b"><p>Pay: $'), text(40 + p % 50), F.lit(",000 - $"), text(95 + p % 4), F.lit(",500 per year</p><p>"), said, F.lit("</p>"), F.col("html")
    )
    html = F.when(p % 4 == 0, short).when(p % 3 == 0, boxed).otherwise(F.concat(F.lit("<p>"), said, F.lit("</p>"), F.col("html")))
    status = F.when(p % 9 == 1, 404).when(p % 9 == 2, 500).when(p % 9 == 3, 410).otherwise(200)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", status.alias("http_status"), html.alias("html"))


@query(
    rf"""WITH {_MADE}, {_READ} SELECT page_id, md5(description) AS text_md5, regexp_matches(left(description, 8000), '{_GONE}') AS gone,
regexp_matches(left(html, 200000) || chr(10) || left(description, 8000), '{_ACCOUNT}') AS account FROM text"""
)
def tx_page_signals(spark, sf_dir) -> DataFrame:
    """Main text of every page, as much of it as a posting keeps (MOST_CHARS), whether it says that the posting is gone, and whether it wants an account."""
    rows = _made(spark, sf_dir).withColumn("text", F.substring(main_content(F.col("html")), 1, MOST_CHARS))
    return rows.select("page_id", F.md5("text").alias("text_md5"), soft_not_found(F.col("text")).alias("gone"), requires_account(F.col("html"), F.col("text")).alias("account"))


@query(
    rf"""WITH {_MADE}, {_READ}, s AS (SELECT page_id, lower(description) AS t FROM text)
SELECT page_id, CASE WHEN regexp_matches(t, '{HOURLY}') AND regexp_matches(t, '{SALARY}') THEN 'both' WHEN regexp_matches(t, '{HOURLY}') THEN 'hourly' WHEN regexp_matches(t, '{SALARY}') THEN 'salary' ELSE 'unknown' END AS compensation_type,
array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in LEVELS.items())}], lambda x: x IS NOT NULL), ',') AS levels FROM s"""
)
def tx_signals(spark, sf_dir) -> DataFrame:
    """How every page's job is paid and what it asks for."""
    told = _made(spark, sf_dir).select("page_id", signals(main_content(F.col("html"))).alias("s"))
    return told.select("page_id", "s.compensation_type", F.array_join("s.education_levels", ",").alias("levels"))


_INSPECTED = rf"""{_MADE}, {_READ}, v AS (SELECT page_id AS posting_id, http_status, html, description AS d, http_status < 400 AS answered, http_status IN (404, 410) AS missing FROM text),
i AS (SELECT *, answered OR missing AS ok, missing OR (answered AND regexp_matches(left(d, 8000), '{_GONE}')) AS dead FROM v),
r AS (SELECT posting_id, ok, dead, answered AND NOT dead AND length(d) < 200 AS unverified, CASE WHEN answered THEN regexp_matches(left(html, 200000) || chr(10) || left(d, 8000), '{_ACCOUNT}') END AS requires_account,
CASE WHEN answered AND NOT dead THEN d END AS description, CASE WHEN answered AND NOT dead AND posting_id % 3 = 0 AND posting_id % 4 <> 0 THEN (40 + posting_id % 50) * 1000.0::DOUBLE END AS low,
CASE WHEN answered AND NOT dead AND posting_id % 3 = 0 AND posting_id % 4 <> 0 THEN (95 + posting_id % 4) * 1000.0::DOUBLE + 500 END AS high FROM i)"""


@query(f"WITH {_INSPECTED} SELECT posting_id, ok, dead, unverified, requires_account, md5(description) AS description_md5, low AS pay_min, high AS pay_max FROM r")
def tx_inspect_pages(spark, sf_dir) -> DataFrame:
    found = inspect_pages(_made(spark, sf_dir).withColumnRenamed("page_id", "posting_id"))
    return found.select("posting_id", "ok", "dead", "unverified", "requires_account", F.md5("description").alias("description_md5"), "pay.pay_min", "pay.pay_max")


@query(
    f"""WITH {POSTINGS}, {_INSPECTED}, c AS (SELECT *, CASE WHEN posting_id % 10 = 0 THEN 1700000000 END AS dead_since, CASE WHEN posting_id % 7 = 0 THEN true END AS wall FROM postings)
SELECT posting_id, CASE WHEN ok AND dead THEN 'dead' WHEN ok AND unverified THEN 'unverified' WHEN ok THEN 'active' ELSE status END AS status,
CASE WHEN ok AND dead THEN coalesce(dead_since, 1706659200) WHEN ok THEN NULL ELSE dead_since END AS dead_since_epoch, md5(CASE WHEN ok AND NOT dead AND description <> '' THEN description ELSE job_description END) AS description_md5,
CASE WHEN ok THEN 1706659200 END AS description_fetched_at, CASE WHEN NOT ok THEN 1706659200 END AS fetch_failed_at, CASE WHEN ok AND NOT dead THEN requires_account ELSE wall END AS requires_account,
CASE WHEN ok AND NOT dead AND coalesce(pay_min, 0) <= 0 AND coalesce(pay_max, 0) <= 0 THEN coalesce(pay_min, low) ELSE pay_min END AS pay_min,
CASE WHEN ok AND NOT dead AND coalesce(pay_min, 0) <= 0 AND coalesce(pay_max, 0) <= 0 THEN coalesce(pay_max, high) ELSE pay_max END AS pay_max,
CASE WHEN ok AND NOT dead AND coalesce(pay_min, 0) <= 0 AND coalesce(pay_max, 0) <= 0 AND low IS NOT NULL THEN coalesce(nullif(pay_period, ''), 'year') ELSE pay_period END AS pay_period
FROM c LEFT JOIN r USING (posting_id)"""
)
def m_apply_inspection(spark, sf_dir) -> DataFrame:
    """Every posting after a visit to the page of its number."""
    key = F.col("posting_id")
    none = lambda kind: F.lit(None).cast(kind)
    current = postings(spark, sf_dir).withColumns(
        {
            "dead_since_epoch": F.when(key % 10 == 0, 1_700_000_000), "requires_account": F.when(key % 7 == 0, True), "description_fetched_at": none("int"), "fetch_failed_at": none("int"),
        }
    )
    out = apply_inspection(current, inspect_pages(_made(spark, sf_dir).withColumnRenamed("page_id", "posting_id")), NOW)
    return out.withColumn("description_md5", F.md5("job_description")).drop("job_description")
