"""Landed board payloads (JSON text) to canonical columns, by what each board calls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.text import clean_html
from boardlake.registry import query

_PAYLOAD = "_posting"


def _at(*paths: str) -> Column:
    """The first of these fields that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(_PAYLOAD, f"$.{p}")), F.lit("")) for p in paths])


def _clean(*paths: str) -> Column:
    return F.nullif(clean_html(_at(*paths)), F.lit(""))


def _joined(sep: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def _iso(milliseconds: Column) -> Column:
    ms = milliseconds.try_cast("bigint")
    return F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _path(base: Column, path: Column) -> Column:
    """base with a path below it; null without a path."""
    return F.concat(base, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def boards() -> dict[str, dict]:
    """Source -> where its postings stand in a payload ("" if the payload is the list) and its columns.

    company names that say nothing (the board's own label) give way to the board's token.
    """
    return {
        "greenhouse": {
            "list": "jobs", "label": "job-boards", "url": _at("absolute_url"), "title": _at("title"), "date": _at("updated_at", "first_published"),
            "location": _at("location.name", "location"), "description": F.lit(None).cast("string"),
        },
        "lever": {
            "list": "", "label": "jobs", "url": _at("hostedUrl"), "title": _at("text"), "date": _iso(_at("createdAt")), "location": _at("categories.location"),
            "description": F.lit(None).cast("string"),
        },
        "workday": {
            "list": "jobPostings", "label": None, "url": _path(F.col("base_url"), _at("externalPath")), "title": _at("title"), "date": _at("postedOn"),
            "location": F.lit(None).cast("string"), "description": F.lit(None).cast("string"),
        },
        "amazon": {
            "list": "jobs", "label": None, "url": F.coalesce(F.when(_at("job_path").isNotNull(), _path(F.lit("https://www.amazon.jobs"), _at("job_path"))), _at("url")),
            "title": _clean("title"), "date": _at("posted_date", "posted_at", "created_at", "updated_time"), "company": F.coalesce(_clean("company_name"), F.lit("Amazon")),
            "location": _joined(", ", _clean("city"), _clean("state"), _clean("country_code")),
            "description": F.when(_clean("description_short", "description").isNotNull(), _joined("\n\n", _clean("description_short", "description"), _clean("basic_qualifications"), _clean("preferred_qualifications"))),
        },
    }


def normalise(payloads: DataFrame) -> DataFrame:
    """Canonical postings of payloads (source, company_name, token, base_url, payload), one row for each URL.

    Blank titles are named, postings without a URL dropped, of equal URLs the least by source and
    title stays. A payload of an unknown source, or one that isn't JSON, gives none.
    """
    text = "array<string>"
    known = boards()
    members = F.coalesce(
        *[F.when(F.col("source") == s, F.from_json(F.get_json_object("payload", f"$.{b['list']}") if b["list"] else F.col("payload"), text)) for s, b in known.items()]
    )
    rows = payloads.select("source", "company_name", "token", "base_url", F.explode(members).alias(_PAYLOAD))

    def pick(column: str) -> Column:
        return F.coalesce(*[F.when(F.col("source") == s, b[column]) for s, b in known.items()])

    name = F.nullif(F.trim("company_name"), F.lit(""))
    company = F.coalesce(*[
        F.when(F.col("source") == s, b.get("company", name if b["label"] is None else F.when(F.lower(name) != b["label"], name).otherwise(F.lower("token"))))
        for s, b in known.items()
    ], F.lower("token"))
    made = rows.select(
        "source", company.alias("company_name"), F.coalesce(pick("title"), F.lit("Untitled Position")).alias("position_name"), pick("url").alias("job_posting_url"),
        pick("date").alias("posting_date"), pick("location").alias("location"), pick("description").alias("job_description"),
    ).filter("job_posting_url is not null")
    columns = ("source", "position_name", "company_name", "posting_date", "location", "job_description")
    return made.groupBy("job_posting_url").agg(F.min(F.struct(*columns)).alias("m")).select("job_posting_url", *[f"m.{c}" for c in columns])


def _landed(part: DataFrame) -> DataFrame:
    """One payload of two postings for each part, in the form of the board that its number names."""
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    title = F.when(key % 5 != 0, F.col("p_name")).otherwise(" ")
    url = F.when(key % 11 != 0, F.concat(F.lit("https://x.example/"), F.expr("p_partkey div 2").cast("string")))
    greenhouse = F.to_json(F.struct(F.array(
        F.struct(url.alias("absolute_url"), title.alias("title"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.lit("2024-01-05").alias("updated_at")),
        F.struct(F.lit("").alias("absolute_url"), title.alias("title"), F.struct(F.lit("").alias("name")).alias("location"), F.lit("").alias("updated_at")),
    ).alias("jobs")))
    lever = F.to_json(F.array(F.struct(url.alias("hostedUrl"), title.alias("text"), F.struct(F.col("p_type").alias("location")).alias("categories"), (F.lit(1700000000000) + key * 1000).alias("createdAt"))))
    workday = F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.concat(F.lit("job/"), text).alias("externalPath"), F.lit("Posted Today").alias("postedOn"))).alias("jobPostings")))
    amazon = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>")).alias("title"), F.concat(F.lit("/en/jobs/"), text).alias("job_path"), F.col("p_brand").alias("city"), F.lit("").alias("state"),
        F.lit("USA").alias("country_code"), F.col("p_type").alias("description_short"), F.lit("Two<br>years").alias("basic_qualifications"), F.lit("July 25, 2026").alias("posted_date"),
    )).alias("jobs")))
    source = F.element_at(F.array(*[F.lit(s) for s in ("greenhouse", "lever", "workday", "amazon")]), (key % 4).cast("int") + 1)
    payload = F.when(key % 4 == 0, greenhouse).when(key % 4 == 1, lever).when(key % 4 == 2, workday).otherwise(amazon)
    company = F.when(key % 3 == 0, "Job-Boards").when(key % 3 == 1, "jobs").otherwise(F.concat(F.lit("Maker "), F.col("p_brand")))
    return part.select(source.alias("source"), company.alias("company_name"), F.col("p_brand").alias("token"), F.lit("https://w.example/en").alias("base_url"), payload.alias("payload"))


@query(
    """WITH r AS (SELECT *, p_partkey % 4 AS k, CASE WHEN p_partkey % 11 <> 0 THEN 'https://x.example/' || (p_partkey // 2) END AS url, CASE WHEN p_partkey % 5 = 0 THEN 'Untitled Position' ELSE trim(p_name) END AS title,
CASE p_partkey % 3 WHEN 0 THEN 'Job-Boards' WHEN 1 THEN 'jobs' ELSE 'Maker ' || p_brand END AS company FROM part),
m AS (SELECT CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' ELSE 'amazon' END AS source,
CASE k WHEN 2 THEN 'https://w.example/en/job/' || p_partkey WHEN 3 THEN 'https://www.amazon.jobs/en/jobs/' || p_partkey ELSE url END AS job_posting_url, CASE WHEN k = 3 THEN trim(p_name) ELSE title END AS position_name,
CASE WHEN k = 3 THEN 'Amazon' WHEN (k = 0 AND company = 'Job-Boards') OR (k = 1 AND company = 'jobs') THEN lower(p_brand) ELSE company END AS company_name,
CASE k WHEN 0 THEN '2024-01-05' WHEN 1 THEN strftime(make_timestamp((1700000000 + p_partkey) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') WHEN 2 THEN 'Posted Today' ELSE 'July 25, 2026' END AS posting_date,
CASE k WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 3 THEN p_brand || ', USA' END AS location, CASE WHEN k = 3 THEN p_type || chr(10) || chr(10) || 'Two years' END AS job_description FROM r)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY job_posting_url ORDER BY source, position_name, company_name, posting_date, location) AS k FROM m WHERE job_posting_url IS NOT NULL) WHERE k = 1"""
)
def io_json_payloads(spark, sf_dir) -> DataFrame:
    return normalise(_landed(spark.read.parquet(f"{sf_dir}/part.parquet")))
