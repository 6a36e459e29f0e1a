"""Composable filters over postings as boolean columns; Catalyst pushes them to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import DAY
from boardlake.registry import query
from boardlake.sources.postings import NOW, POSTINGS, postings


def _has(column: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(term.lower()))


def search(terms: str) -> Column:
    """Every term occurs in company, title or location."""
    each = [reduce(Column.__or__, [_has(c, t) for c in ("company_name", "position_name", "location")]) for t in terms.split()]
    return reduce(Column.__and__, each, F.lit(True))


def any_of(column: str, terms: list[str]) -> Column:
    return reduce(Column.__or__, [_has(column, t) for t in terms])


def all_of(column: str, terms: list[str]) -> Column:
    return reduce(Column.__and__, [_has(column, t) for t in terms])


def none_of(column: str, terms: list[str]) -> Column:
    """Rows without a value stay."""
    return ~any_of(column, terms)


def pay_range(low: float | None = None, high: float | None = None, unknown: bool = True) -> Column:
    """Overlap with a pay range; null or not positive pay is unknown."""
    top = F.coalesce(F.when(F.col("pay_max") > 0, F.col("pay_max")), F.when(F.col("pay_min") > 0, F.col("pay_min")))
    bottom = F.coalesce(F.when(F.col("pay_min") > 0, F.col("pay_min")), F.when(F.col("pay_max") > 0, F.col("pay_max")))
    fits = F.lit(True)
    if low is not None:
        fits = fits & (top >= low)
    if high is not None:
        fits = fits & (bottom <= high)
    return F.when(top.isNull(), F.lit(unknown)).otherwise(fits)


def has_pay() -> Column:
    return F.coalesce("pay_max", "pay_min", F.lit(0.0)) > 0


def education(levels: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split("education_levels", ","), F.array(*[F.lit(x) for x in levels])), F.lit(False))


def seen_within(column: str, days: int, now: int) -> Column:
    return F.col(column) >= now - days * DAY


def visibility(mode: str, now: int, window: int) -> Column:
    hidden, fresh = F.col("hidden"), F.col("last_seen_epoch") >= now - window
    return {
        "visible": ~hidden & fresh,
        "hidden": hidden,
        "stale_dated": F.coalesce(F.col("hidden_reason") == "outside_date_window", F.lit(False)),
        "delisted": F.coalesce(F.col("hidden_reason") == "delisted", F.lit(False)),
        "open": ~hidden,
        "all": F.lit(True),
    }[mode]


SPECS = {
    "widgets": lambda: search("widget src1"),
    "well paid": lambda: pay_range(low=100_000, unknown=False),
    "graduates": lambda: education(["masters", "doctorate"]),
    "fresh": lambda: seen_within("last_seen_epoch", 2, NOW),
}


@query(f"WITH {POSTINGS} SELECT posting_id FROM postings WHERE (lower(company_name) LIKE '%widget%' OR lower(position_name) LIKE '%widget%' OR lower(location) LIKE '%widget%') AND (lower(company_name) LIKE '%src1%' OR lower(position_name) LIKE '%src1%' OR lower(location) LIKE '%src1%')")
def q_search(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).filter(search("widget src1")).select("posting_id")


@query(
    f"""WITH {POSTINGS} SELECT posting_id FROM postings WHERE (position_name LIKE '%red%' OR position_name LIKE '%blue%')
AND (lower(position_name) LIKE '%e%' AND lower(position_name) LIKE '%o%') AND (location IS NULL OR lower(location) NOT LIKE '%wa%')"""
)
def q_any_all_none(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).filter(
        any_of("position_name", ["red", "blue"]) & all_of("position_name", ["e", "o"]) & none_of("location", ["wa"])
    ).select("posting_id")


@query(
    f"""WITH {POSTINGS} SELECT pay_period, compensation_type, count(*) AS n, count(*) FILTER (coalesce(pay_max, pay_min, 0) > 0) AS with_pay FROM postings
WHERE pay_max IS NULL OR (pay_max >= 80000 AND pay_min <= 110000) GROUP BY 1, 2"""
)
def q_pay_range(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).filter(pay_range(80_000, 110_000)).groupBy("pay_period", "compensation_type").agg(
        F.count("*").alias("n"), F.count_if(has_pay()).alias("with_pay")
    )


@query(f"WITH {POSTINGS} SELECT posting_id FROM postings WHERE list_has_any(string_split(education_levels, ','), ['masters', 'doctorate']) AND last_seen_epoch >= 1706659200 - 3 * 86400")
def q_education_seen(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).filter(education(["masters", "doctorate"]) & seen_within("last_seen_epoch", 3, NOW)).select("posting_id")


@query(
    f"""WITH {POSTINGS} SELECT count(*) FILTER (NOT hidden AND last_seen_epoch >= 1706659200 - 604800) AS visible, count(*) FILTER (hidden) AS hidden,
count(*) FILTER (hidden_reason = 'outside_date_window') AS stale_dated, count(*) FILTER (hidden_reason = 'delisted') AS delisted,
count(*) FILTER (NOT hidden) AS open, count(*) AS all_ FROM postings"""
)
def q_visibility(spark, sf_dir) -> DataFrame:
    modes = ("visible", "hidden", "stale_dated", "delisted", "open", "all")
    return postings(spark, sf_dir).agg(*[F.count_if(visibility(m, NOW, 604_800)).alias("all_" if m == "all" else m) for m in modes])


@query(
    f"""WITH {POSTINGS}, t AS (
SELECT 'widgets' AS spec FROM postings WHERE lower(coalesce(company_name, '') || '|' || coalesce(position_name, '') || '|' || coalesce(location, '')) LIKE '%widget%' AND lower(coalesce(company_name, '') || '|' || coalesce(position_name, '') || '|' || coalesce(location, '')) LIKE '%src1%'
UNION ALL SELECT 'well paid' FROM postings WHERE pay_max >= 100000
UNION ALL SELECT 'graduates' FROM postings WHERE list_has_any(string_split(education_levels, ','), ['masters', 'doctorate'])
UNION ALL SELECT 'fresh' FROM postings WHERE last_seen_epoch >= 1706659200 - 2 * 86400)
SELECT spec, count(*) AS n FROM t GROUP BY spec"""
)
def q_run_specs(spark, sf_dir) -> DataFrame:
    """All saved filters in one pass; every posting is tagged with those it meets."""
    tags = F.array_compact(F.array(*[F.when(make(), F.lit(name)) for name, make in SPECS.items()]))
    return postings(spark, sf_dir).select(F.explode(tags).alias("spec")).groupBy("spec").agg(F.count("*").alias("n"))
