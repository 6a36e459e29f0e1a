"""Fields as they land: lists, links, flags, amounts and names of kinds; and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.dates import posting_epoch
from boardlake.functions.sources import URLS
from boardlake.functions.text import like_text
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

# Other spellings of kinds of pay and levels of education, and the currencies known.
COMPENSATION = {
    "hourly": "hourly", "wage": "hourly", "wages": "hourly", "per_hour": "hourly", "per-hour": "hourly", "hour": "hourly", "salary": "salary",
    "annual": "salary", "annually": "salary", "yearly": "salary", "per_year": "salary", "per-year": "salary", "year": "salary", "both": "both",
}
PERIODS = ("hour", "week", "month", "year")
STATUSES = ("applied", "interview scheduled", "awaiting response", "offer received", "withdrawn", "denied")
FITS = ("good fit", "stretch", "overqualified", "underqualified")
SORTS = ("recent", "company_asc", "first_seen_desc", "match_desc")
CURRENCIES = ("USD", "CAD", "AUD", "EUR", "GBP", "JPY", "NZD", "CHF", "SEK", "NOK", "DKK", "INR")
EDUCATION = {
    "high_school": "high_school", "high school": "high_school", "ged": "high_school", "associate": "associate", "associates": "associate",
    "associate_degree": "associate", "bachelor": "bachelor", "bachelors": "bachelor", "ba": "bachelor", "bs": "bachelor", "b.a.": "bachelor",
    "b.s.": "bachelor", "master": "master", "masters": "master", "mba": "master", "ms": "master", "ma": "master", "m.s.": "master", "m.a.": "master",
    "doctorate": "doctorate", "doctoral": "doctorate", "doctor": "doctorate", "phd": "doctorate", "ph.d.": "doctorate",
    "certificate": "certificate", "certification": "certificate", "certified": "certificate", "diploma": "certificate",
}
#: Sources whose dates are the times of the pass that saw them.
PASS_DATED = ("paycor", "prismhr")


def _key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[_key(c)]


def compensation_type(c: Column) -> Column:
    return F.coalesce(_named(c, COMPENSATION), F.lit("unknown"))


def pay_period(c: Column) -> Column:
    return F.when(_key(c).isin(*PERIODS), _key(c)).otherwise("")


def currency(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.isin(*CURRENCIES), code)


def csv_list(c: Column) -> Column:
    """Trimmed items between commas; empty ones go."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def education_list(c: Column) -> Column:
    """Distinct known levels of a comma-separated or JSON list."""
    items = F.when(F.trim(c).startswith("["), json_list(c)).otherwise(csv_list(c))
    return F.array_compact(F.array_distinct(F.transform(items, lambda x: _named(x, EDUCATION))))


def json_list(c: Column) -> Column:
    """Trimmed items of a JSON list of texts; a text that isn't one is an empty list."""
    items = F.coalesce(F.from_json(F.coalesce(c, F.lit("")), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def base64_text(c: Column) -> Column:
    """Decoded text, or an empty one."""
    raw = F.try_to_binary(F.trim(c), F.lit("base64"))
    return F.coalesce(F.decode(raw, "UTF-8"), F.lit(""))


def pay_number(c: Column) -> Column:
    """A positive amount without its thousands marks, or null."""
    value = F.regexp_replace(F.trim(c.cast("string")), "[,$]", "").try_cast("double")
    return F.when(value > 0, value)


def bool_flag(c: Column, default: bool = False) -> Column:
    return F.when(_key(c).isin("1", "true", "yes", "on"), True).when(_key(c).isin("0", "false", "no", "off"), False).otherwise(default)


def nonneg_int(c: Column) -> Column:
    """The whole number that a text begins with; 0 if there is none or it is below 0."""
    n = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))


def pos_int(c: Column, default: int = 0) -> Column:
    """The positive whole number that a text begins with, else the default."""
    return F.when(nonneg_int(c) > 0, nonneg_int(c)).otherwise(F.lit(default).cast("bigint"))


def _one_of(c: Column, options: tuple[str, ...], default: str) -> Column:
    text = like_text(c)
    return F.when(text.isin(*options), text).otherwise(default)


def app_status(c: Column) -> Column:
    return _one_of(c, STATUSES, "applied")


def fit(c: Column) -> Column:
    """Blank is a value: not assessed yet."""
    return _one_of(c, FITS, "")


def applied_by_type(c: Column) -> Column:
    return _one_of(c, ("ai", "agent"), "manual")


def applied_by_label(c: Column, kind: Column) -> Column:
    made = F.when(kind.isin("ai", "agent"), "AI agent applied on behalf of user").otherwise("Manually applied by user")
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), made)


def ignored_by(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Ignored by user"))


def sort_name(c: Column) -> Column:
    text = like_text(c)
    return F.when(text == "alphabetical", "company_asc").otherwise(_one_of(c, SORTS, "recent"))


def remote_modes(c: Column) -> Column:
    """Work modes of a comma list; anything unknown among them, or nothing, is all."""
    modes = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda m: F.trim(m)), lambda m: m != "")
    every = (F.size(modes) == 0) | F.exists(modes, lambda m: ~m.isin("remote", "hybrid", "non_remote"))
    return F.when(every, F.array(F.lit("all"))).otherwise(F.array_distinct(modes))


def url_join(base: Column, part: Column) -> Column:
    """part against base: whole addresses as they are, "//host" and "/path" at the base's scheme and host, others beside its last
    segment; null for a blank part, another scheme or an unusable base. Dots in paths are left as they are."""
    p, b = F.nullif(F.trim(part), F.lit("")), normalize_url(base)
    origin, folder = F.regexp_extract(b, r"^(?i)(https?://[^/?#]+)", 1), F.regexp_extract(b, r"^(?i)(https?://[^/?#]+[^?#]*/)", 1)
    return (
        F.when(p.isNull(), None).when(p.rlike("^(?i)https?://"), p).when(p.rlike("^(?i)[a-z][a-z0-9+.-]*:"), None).when(b.isNull(), None)
        .when(p.startswith("//"), F.concat(F.regexp_extract(b, "^(?i)(https?:)", 1), p)).when(p.startswith("/"), F.concat(origin, p))
        .otherwise(F.concat(F.when(folder.rlike("^(?i)https?://[^/]+/"), folder).otherwise(F.concat(origin, F.lit("/"))), p))
    )


def normalize_url(c: Column) -> Column:
    """A link by http or https, https where none is named; other schemes and blanks are null."""
    text = F.trim(c)
    return F.when(text.rlike(r"(?i)^https?://[^\s/]+"), text).when(text.rlike(r"^[\w-]+(\.[\w-]+)+(:\d+)?([/?#]|$)"), F.concat(F.lit("https://"), text))


def location_from_url(c: Column) -> Column:
    """The part after /job/ of a link that goes on behind it: two dashes as a dash, one as a space."""
    raw = F.coalesce(F.try_url_decode(F.regexp_extract(c, r"(?i)^https?://[^/?#]+(?:/[^/?#]+)*?/job/([^/?#]+)/[^/?#]+", 1)), F.lit(""))
    text = F.replace(F.replace(F.regexp_replace(raw, "--+", "\x01"), F.lit("-"), F.lit(" ")), F.lit("\x01"), F.lit("- "))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def days_in_window(c: Column, days: int) -> Column:
    """Whether a text such as "Posted 3 Days Ago" is that recent; "30+ days" and blanks aren't."""
    text = F.regexp_replace(_key(c), r"^posted\s+", "")
    age = F.when(text == "today", 0).when(text == "yesterday", 1).otherwise(F.regexp_extract(text, r"^(\d+)\s+days?\s+ago$", 1).try_cast("int"))
    return F.coalesce(age <= days, F.lit(False))


def real_source_date(raw: Column, source: Column, first_seen: Column, last_seen: Column, now: int) -> Column:
    """Whether a date can be read and isn't just the time of the pass (within five seconds), as two sources give it."""
    date = posting_epoch(raw, now)
    told = date.isNotNull() & ~_key(raw).rlike("source date unavailable|synced to database")
    near = lambda seen: F.coalesce((seen > 0) & (F.abs(date - seen) <= 5), F.lit(False))
    return told & ~(_key(source).isin(*PASS_DATED) & (near(first_seen) | near(last_seen)))


#: Functions for Spark SQL, as SQL bodies: Catalyst puts them in line, so nothing leaves the JVM.
SQL_FUNCTIONS = {
    "like_text": ("x STRING", "STRING", r"lower(trim(regexp_replace(x, '\\s+', ' ')))"),
    "company_key": ("x STRING", "STRING", r"lower(trim(regexp_replace(x, '\\s+', ' ')))"),
    "clamp": ("x BIGINT, low BIGINT, high BIGINT", "BIGINT", "greatest(low, least(high, x))"),
    "work_mode": (
        "x STRING", "STRING",
        r"CASE WHEN x rlike '(?i)\\bhybrid\\b' THEN 'hybrid' WHEN x rlike '(?i)\\bremote\\b|work from home|\\bwfh\\b' THEN 'remote' ELSE 'non_remote' END",
    ),
    "title_words": (
        "x STRING", "ARRAY<STRING>",
        "array_distinct(filter(split(regexp_replace(lower(x), '[^a-z0-9&/ -]', ' '), '[ /-]+'), "
        "w -> length(w) > 2 AND w NOT IN ('and', 'for', 'the', 'with') AND NOT w rlike '^[0-9]+$'))",
    ),
    "csv_list": ("x STRING", "ARRAY<STRING>", "filter(transform(split(coalesce(x, ''), ','), w -> trim(w)), w -> w <> '')"),
    "stem6": ("x STRING", "STRING", "substring(x, 1, 6)"),
    "infer_source": ("x STRING", "STRING", "CASE " + " ".join(f"WHEN lower(trim(x)) rlike r'{pattern}' THEN '{key}'" for key, pattern in URLS) + " END"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql in this session."""
    for name, (takes, gives, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")


_SPELLINGS = ["Per_Hour", " yearly", "both", "gig", None]
_LEVELS = ["GED, mba,B.A.", "[\"PhD\", \"diploma\", \"m.s.\", \"doctor\"]", "", "wizard"]
_LINKS = ["https://x.example.com/en/job/Seattle-WA/1", "jobs.example.org/a", "ftp://a.example.com", "http://x.example.com/job/Paris--Main%20Site/2?x=1"]


def _pick(values: list, key: str = "posting_id") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int") + 1)


@query(
    f"""WITH {POSTINGS}, k(r, kind) AS (VALUES (0, 'hourly'), (1, 'salary'), (2, 'both'), (3, 'unknown'), (4, 'unknown')),
l(r, levels) AS (VALUES (0, 'high_school,master,bachelor'), (1, 'doctorate,certificate,master'), (2, ''), (3, '')),
u(r, link, place) AS (VALUES (0, 'https://x.example.com/en/job/Seattle-WA/1', 'Seattle WA'), (1, 'https://jobs.example.org/a', NULL), (2, NULL, NULL),
(3, 'http://x.example.com/job/Paris--Main%20Site/2?x=1', 'Paris- Main Site'))
SELECT posting_id, kind, levels, link, place, CASE WHEN pay_min > 0 THEN pay_min END AS pay, coalesce(pay_period, '') AS period
FROM postings JOIN k ON posting_id % 5 = k.r JOIN l ON posting_id % 4 = l.r JOIN u ON posting_id % 4 = u.r"""
)
def sc_fields(spark, sf_dir) -> DataFrame:
    link = _pick(_LINKS)
    return postings(spark, sf_dir).select(
        "posting_id", compensation_type(_pick(_SPELLINGS)).alias("kind"), F.array_join(education_list(_pick(_LEVELS)), ",").alias("levels"),
        normalize_url(link).alias("link"), location_from_url(link).alias("place"),
        pay_number(F.format_number("pay_min", 2)).alias("pay"), pay_period(F.col("pay_period")).alias("period"),
    )


@query(
    f"""WITH {POSTINGS} SELECT posting_id, coalesce(CASE WHEN posting_date = 'yesterday' THEN 1 WHEN posting_date LIKE '% days ago' THEN string_split(posting_date, ' ')[1]::INT END <= 7, false) AS in_week,
posting_id % 6 IN (0, 1, 2) AS dated FROM postings"""
)
def dt_source_dates(spark, sf_dir) -> DataFrame:
    from boardlake.sources.postings import NOW

    date = F.col("posting_date")
    return postings(spark, sf_dir).select(
        "posting_id", days_in_window(date, 7).alias("in_week"),
        real_source_date(date, F.col("source"), F.col("first_seen_epoch"), F.col("last_seen_epoch"), NOW).alias("dated"),
    )


@query(
    f"""WITH {POSTINGS} SELECT lower(trim(company_name)) AS company, CASE WHEN regexp_matches(location, '(?i)\\bhybrid\\b') THEN 'hybrid'
WHEN regexp_matches(location, '(?i)\\bremote\\b|work from home|\\bwfh\\b') THEN 'remote' ELSE 'non_remote' END AS mode, count(*) AS n,
sum(len(string_split(education_levels, ',')))::BIGINT AS levels FROM postings GROUP BY 1, 2"""
)
def fn_sql_functions(spark, sf_dir) -> DataFrame:
    """The registered functions from Spark SQL."""
    register(spark)
    postings(spark, sf_dir).createOrReplaceTempView("boardlake_postings")
    return spark.sql(
        "SELECT company_key(company_name) AS company, work_mode(location) AS mode, count(*) AS n, sum(nullif(size(csv_list(education_levels)), 0)) AS levels "
        "FROM boardlake_postings GROUP BY 1, 2"
    )


_KINDS = """CASE p_partkey % 9 WHEN 0 THEN ' Interview   Scheduled ' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'ghosted' WHEN 3 THEN 'Good Fit' WHEN 4 THEN 'AGENT' WHEN 5 THEN 'Alphabetical' WHEN 6 THEN 'remote, Hybrid,remote' WHEN 7 THEN 'remote, moon' ELSE p_name END"""


@query(
    f"""WITH k AS (SELECT p_partkey, p_partkey % 9 AS i, {_KINDS} AS x, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_partkey || ' rows' WHEN 1 THEN '-' || p_partkey WHEN 2 THEN 'none' ELSE '+' || p_partkey END AS n,
CASE p_partkey % 5 WHEN 0 THEN '/a/' || p_partkey WHEN 1 THEN 'b?c=' || p_partkey WHEN 2 THEN '//other.example/' || p_partkey WHEN 3 THEN 'mailto:x' ELSE 'http://y.example/' || p_partkey END AS part FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN 'interview scheduled' WHEN 1 THEN 'denied' ELSE 'applied' END AS status, CASE i WHEN 3 THEN 'good fit' ELSE '' END AS fit, CASE i WHEN 4 THEN 'agent' ELSE 'manual' END AS by_type,
CASE WHEN i = 4 THEN 'AI agent applied on behalf of user' ELSE 'Manually applied by user' END AS by_label, CASE i WHEN 5 THEN 'company_asc' ELSE 'recent' END AS sort, CASE i WHEN 6 THEN 'remote,hybrid' ELSE 'all' END AS modes,
CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 3 THEN p_partkey ELSE 0 END AS whole, CASE WHEN p_partkey % 4 IN (0, 3) AND p_partkey > 0 THEN p_partkey ELSE 7 END AS positive,
CASE p_partkey % 5 WHEN 0 THEN 'https://x.example' || part WHEN 1 THEN 'https://x.example/jobs/' || part WHEN 2 THEN 'https:' || part WHEN 4 THEN part END AS link FROM k"""
)
def sc_kinds(spark, sf_dir) -> DataFrame:
    """Kinds, whole numbers and links of every part in several spellings."""
    n = "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_partkey || ' rows' WHEN 1 THEN '-' || p_partkey WHEN 2 THEN 'none' ELSE '+' || p_partkey END"
    part = "CASE p_partkey % 5 WHEN 0 THEN '/a/' || p_partkey WHEN 1 THEN 'b?c=' || p_partkey WHEN 2 THEN '//other.example/' || p_partkey WHEN 3 THEN 'mailto:x' ELSE 'http://y.example/' || p_partkey END"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{_KINDS} AS x", f"{n} AS n", f"{part} AS part")
    x = F.col("x")
    return rows.select(
        "p_partkey", app_status(x).alias("status"), fit(x).alias("fit"), applied_by_type(x).alias("by_type"), applied_by_label(F.lit(" "), applied_by_type(x)).alias("by_label"),
        sort_name(x).alias("sort"), F.array_join(remote_modes(x), ",").alias("modes"), nonneg_int(F.col("n")).alias("whole"), pos_int(F.col("n"), 7).alias("positive"),
        url_join(F.lit("x.example/jobs/list"), F.col("part")).alias("link"),
    )
