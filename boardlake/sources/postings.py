"""Postings from the documents table: every document is a job description of one posting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706659200  # 2024-01-31 00:00 UTC
LOCATIONS = [
    "Seattle, WA", "Kent, WA", "Perth, WA, Australia", "US-WA-Redmond", "Washington, DC", "Remote - USA", "Denver, CO; Austin, TX",
    "Berlin, Germany", "Hybrid - Boston, MA", None, "London, United Kingdom", "Portland, OR 97201", "", "Mumbai, India",
    "Chicago, IL or Remote", "Florence Kentucky",
]
_LIST = ", ".join("NULL" if x is None else f"'{x}'" for x in LOCATIONS)

#: Columns besides the titles, in SQL that Spark and DuckDB both run; {at} picks a location.
_COLUMNS = """
doc_id AS posting_id, 'Company ' || source AS company_name, p_name || ' ' || p_type AS position_name,
'https://' || source || '.example.com/job/' || CAST(doc_id AS {text}) AS job_posting_url, {at} AS location,
CASE doc_id % 6 WHEN 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS {text}), 2, '0')
  WHEN 1 THEN CAST(doc_id % 20 AS {text}) || ' days ago' WHEN 2 THEN 'yesterday' WHEN 3 THEN '' WHEN 4 THEN 'n/a'
  ELSE 'Posted ' || CAST(doc_id % 30 AS {text}) || 'd' END AS posting_date,
1706659200 - (doc_id * 37 % 400) * 3600 AS first_seen_epoch, 1706659200 - (doc_id * 11 % 260) * 3600 AS last_seen_epoch,
doc_id % 13 = 0 AS hidden, CASE WHEN doc_id % 26 = 0 THEN 'delisted' WHEN doc_id % 13 = 0 THEN 'outside_date_window' END AS hidden_reason,
CASE WHEN doc_id % 13 = 0 THEN 1706659200 - (doc_id * 7 % 1000) * 3600 END AS hidden_at_epoch,
CASE WHEN doc_id % 17 = 0 THEN 'dead' ELSE 'open' END AS status,
CASE WHEN doc_id % 5 <> 0 THEN CAST(30000 + (doc_id * 13 % 900) * 100 AS DOUBLE) END AS pay_min,
CASE WHEN doc_id % 5 <> 0 THEN CAST(50000 + (doc_id * 13 % 900) * 100 AS DOUBLE) END AS pay_max,
CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'hour' ELSE 'year' END END AS pay_period,
CASE doc_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'salary' WHEN 2 THEN 'both' END AS compensation_type,
CASE doc_id % 3 WHEN 0 THEN 'bachelors,masters' WHEN 1 THEN 'high_school' END AS education_levels,
text AS job_description, lang, source
"""

#: The same table as a DuckDB common table expression.
POSTINGS = (
    "postings AS (SELECT "
    + _COLUMNS.format(text="VARCHAR", at=f"([{_LIST}])[CAST(doc_id % 16 AS INT) + 1]")
    + " FROM documents JOIN part ON p_partkey = doc_id % 200)"
)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    titles = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey < 200")  # 200 rows at any scale
    joined = documents.join(F.broadcast(titles), F.col("p_partkey") == F.col("doc_id") % 200)
    columns = _COLUMNS.format(text="STRING", at=f"element_at(array({_LIST}), CAST(doc_id % 16 AS INT) + 1)")
    return joined.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """Single expressions of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and columns.count("'", 0, i) % 2 == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of users' actions on postings: url key, action, epoch."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id AS posting_id", "unix_timestamp(ts) AS acted",
        "CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'shortlist' WHEN 'signup' THEN 'apply' ELSE 'ignore' END AS action",
    )


ACTIONS = """actions AS (SELECT event_id, user_id AS posting_id, CAST(floor(epoch(ts)) AS BIGINT) AS acted,
CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'shortlist' WHEN 'signup' THEN 'apply' ELSE 'ignore' END AS action
FROM events)"""
