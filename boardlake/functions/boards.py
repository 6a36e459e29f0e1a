"""What an address is as a source of postings: a company's board that can be taken in, a board of many companies, or neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.fields import normalize_url
from boardlake.functions.sources import infer_source
from boardlake.registry import query

#: Sources that one sweep takes in whole, so that a company's address on them is no source of its own.
WHOLE_BOARDS = """governmentjobs smartrecruiters policeapp usajobs k12jobspot schoolspring calcareers calopps statejobsny edjoin webcruiter academicjobsonline
amazon expedia microsoft boeing""".split()
_LOCALE = r"(?:[a-z]{2}(?:-[a-z]{2})?/)?"
#: Source, key of its identifier, and pattern of a company's address, whose first group is the identifier.
COMPANY_BOARDS = (
    ("workday", "tenant", r"^https?://([\w-]+)\.wd\d+\.myworkdayjobs\.com(?:/|$)"),
    ("ashby", "organizationHostedJobsPageName", r"^https?://jobs\.ashbyhq\.com/([^/?#]+)"),
    ("greenhouse", "boardToken", r"^https?://(?:job-)?boards\.greenhouse\.io/([^/?#]+)"),
    ("lever", "organization", r"^https?://jobs\.lever\.co/([^/?#]+)"),
    ("recruitee", "subdomain", r"^https?://(?!www\.)([\w-]+)\.recruitee\.com(?:/|$)"),
    ("jobvite", "companySlug", r"^https?://(?:jobs|careers)\.jobvite\.com/" + _LOCALE + "([^/?#]+)"),
    ("applytojob", "subdomain", r"^https?://(?!www\.)([\w-]+)\.applytojob\.com(?:/|$)"),
    ("breezy", "subdomain", r"^https?://(?!www\.|app\.)([\w-]+)\.breezy\.hr(?:/|$)"),
    ("bamboohr", "subdomain", r"^https?://(?!www\.)([\w-]+)\.bamboohr\.com(?:/|$)"),
    ("teamtailor", "subdomain", r"^https?://(?!www\.)([\w-]+)\.teamtailor\.com(?:/|$)"),
    ("freshteam", "subdomain", r"^https?://(?!www\.)([\w-]+)\.freshteam\.com(?:/|$)"),
    ("pinpointhq", "subdomain", r"^https?://(?!www\.)([\w-]+)\.pinpointhq\.com(?:/|$)"),
    ("personio", "subdomain", r"^https?://([\w-]+)\.jobs\.personio\.(?:com|de)(?:/|$)"),
)


def classify_source_url(url: Column) -> Column:
    """Struct of supported, reason, normalized_url, source, key, identifier and suggested_name.

    reason is invalid_url, dynamic_ats_not_supported (a board of many companies), seeded_match (then the company's identifier and a
    name made from it are told), seeded_parser_not_available (a known source, but no company's address) or unrecognized_or_not_seeded.
    """
    none = F.lit(None).cast("string")

    def told(link: Column) -> Column:
        def by(source: Column) -> Column:
            reason = (
                F.when(link.isNull(), "invalid_url").when(source["name"].isin(*WHOLE_BOARDS), "dynamic_ats_not_supported").when(source["match"].isNotNull(), "seeded_match")
                .when(source["name"].isNotNull(), "seeded_parser_not_available").otherwise("unrecognized_or_not_seeded")
            )
            match = F.when(reason == "seeded_match", source["match"])
            name = F.trim(F.regexp_replace(match["identifier"], "[_-]+", " "))
            return F.struct(
                (reason == "seeded_match").alias("supported"), reason.alias("reason"), F.coalesce(link, F.lit("")).alias("normalized_url"),
                F.coalesce(match["source"], F.when(reason.isin("dynamic_ats_not_supported", "seeded_parser_not_available"), source["name"])).alias("source"),
                match["key"].alias("key"), match["identifier"].alias("identifier"), F.coalesce(F.nullif(name, F.lit("")), F.when(match.isNotNull(), match["source"]), none).alias("suggested_name"),
            )

        found = F.coalesce(
            *[F.when(F.lower(link).rlike(p), F.struct(F.lit(s).alias("source"), F.lit(k).alias("key"), F.regexp_extract(link, f"(?i){p}", 1).alias("identifier"))) for s, k, p in COMPANY_BOARDS]
        )
        return F.get(F.transform(F.array(F.struct(infer_source(link).alias("name"), found.alias("match"))), by), F.lit(0))

    return F.get(F.transform(F.array(normalize_url(url)), told), F.lit(0))


#: Addresses of each page's company in SQL; n is its name.
_ADDRESS = """CASE page_id % 12 WHEN 0 THEN 'https://' || n || '.wd5.myworkdayjobs.com/en-US/careers' WHEN 1 THEN 'jobs.ashbyhq.com/' || n WHEN 2 THEN 'https://boards.greenhouse.io/' || n || '/jobs/1' WHEN 3 THEN 'https://jobs.lever.co/' || n || '?x=1'
WHEN 4 THEN 'http://' || n || '.recruitee.com' WHEN 5 THEN 'https://jobs.smartrecruiters.com/' || n WHEN 6 THEN 'ftp://' || n || '.example.com' WHEN 7 THEN 'https://www.bamboohr.com/careers' WHEN 8 THEN 'https://' || n || '.example.com/jobs'
WHEN 9 THEN 'https://jobs.jobvite.com/en/' || n || '/job/a' WHEN 10 THEN '' ELSE 'https://' || n || '.jobs.personio.de/job/7' END"""


@query(
    f"""WITH p AS (SELECT page_id, page_id % 12 AS k, 'Big-Co_' || page_id AS n, {_ADDRESS.replace("|| n ||", "|| 'Big-Co_' || page_id ||").replace("|| n W", "|| 'Big-Co_' || page_id W")} AS url FROM pages),
c AS (SELECT *, CASE WHEN k IN (6, 10) THEN 'invalid_url' WHEN k = 5 THEN 'dynamic_ats_not_supported' WHEN k = 7 THEN 'seeded_parser_not_available' WHEN k = 8 THEN 'unrecognized_or_not_seeded' ELSE 'seeded_match' END AS reason FROM p)
SELECT page_id, reason = 'seeded_match' AS supported, reason, CASE WHEN k IN (6, 10) THEN '' WHEN k = 1 THEN 'https://' || url ELSE url END AS normalized_url,
CASE k WHEN 0 THEN 'workday' WHEN 1 THEN 'ashby' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever' WHEN 4 THEN 'recruitee' WHEN 5 THEN 'smartrecruiters' WHEN 7 THEN 'bamboohr' WHEN 9 THEN 'jobvite' WHEN 11 THEN 'personio' END AS source,
CASE WHEN reason = 'seeded_match' THEN CASE k WHEN 0 THEN 'tenant' WHEN 1 THEN 'organizationHostedJobsPageName' WHEN 2 THEN 'boardToken' WHEN 3 THEN 'organization' WHEN 9 THEN 'companySlug' ELSE 'subdomain' END END AS key,
CASE WHEN reason = 'seeded_match' THEN n END AS identifier, CASE WHEN reason = 'seeded_match' THEN 'Big Co ' || page_id END AS suggested_name FROM c"""
)
def sc_classify_source(spark, sf_dir) -> DataFrame:
    """What the address of each page's company is as a source."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "'Big-Co_' || page_id AS n").selectExpr("page_id", f"{_ADDRESS} AS url")
    return rows.select("page_id", classify_source_url(F.col("url")).alias("c")).select("page_id", "c.*")
