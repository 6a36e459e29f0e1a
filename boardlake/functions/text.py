"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import CORPUS_STOPWORDS
from boardlake.functions.enrich import decode_entities
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

#: Letters that are an ASCII letter with marks, and that letter.
_MARKED = {chr(c): b for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (b := unicodedata.normalize("NFD", chr(c))[0]).isascii() and b.isalpha() and chr(c).islower()}
_ACCENTED, _PLAIN = "".join(_MARKED), "".join(_MARKED.values())
TITLE_STOPWORDS = ("and", "for", "the", "with")


def like_text(c: Column) -> Column:
    """Trimmed, lower case, white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def geo_text(c: Column) -> Column:
    """Without accents, lower case, & as and, other marks as one space."""
    plain = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "['’]", ""), "[^a-z0-9]+", " "))


def clean_html(c: Column) -> Column:
    """Tags as spaces, entities decoded, white space as one space."""
    c = decode_entities(F.replace(F.regexp_replace(c, "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_words(c: Column) -> Column:
    """Distinct words of a title that say something: over two letters, no stopword, no bare number."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9&/ -]", " ")
    words = F.split(kept, "[ /-]+")
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOPWORDS) & ~w.rlike("^[0-9]+$"))
    )


def raw_tokens(c: Column) -> Column:
    """Lower case, letters and digits with +#- inside, 3 to 30 long, no number."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9](?:[a-z0-9+#-]*[a-z0-9])?"), F.lit(0))
    return F.filter(words, lambda w: F.length(w).between(3, 30) & (F.translate(w, "0123456789", "") != ""))


def tokens(c: Column) -> Column:
    """Search tokens: those without words that every posting has."""
    return F.filter(raw_tokens(c), lambda w: ~w.isin(*CORPUS_STOPWORDS))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))


def path_slug(c: Column) -> Column:
    return F.regexp_extract(c, r"^https?://[^/?#]+/([^/?#]+)", 1)


def company_from_url(c: Column) -> Column:
    """First label of the host that says something, separators as spaces."""
    labels = F.filter(F.split(host(c), "[.]"), lambda w: ~w.isin("www", "jobs", "careers", "m", "apply"))
    return F.regexp_replace(F.element_at(labels, 1), "[-_]+", " ")


@query(
    f"""WITH {POSTINGS} SELECT posting_id, lower(trim(regexp_replace(position_name, '\\s+', ' ', 'g'))) AS like_text,
trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(location)), '&', ' and ', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS geo_text
FROM postings"""
)
def sc_text_forms(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).select("posting_id", like_text(F.col("position_name")).alias("like_text"), geo_text(F.col("location")).alias("geo_text"))


@query(
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages"""
)
def sc_clean_html(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(clean_html(F.col("html"))).alias("text_md5"))


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1) AS slug,
regexp_replace(list_filter(string_split(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.'), lambda w: w NOT IN ('www', 'jobs', 'careers', 'm', 'apply'))[1], '[-_]+', ' ', 'g') AS company FROM pages"""
)
def sc_url_parts(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", host(url).alias("host"), path_slug(url).alias("slug"), company_from_url(url).alias("company")
    )


@query(
    f"""WITH {POSTINGS}, w AS (SELECT posting_id, unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(position_name), '[^a-z0-9&/ -]', ' ', 'g'), '[ /-]+'),
lambda x: length(x) > 2 AND x NOT IN ('and', 'for', 'the', 'with') AND NOT regexp_matches(x, '^[0-9]+$')))) AS word FROM postings)
SELECT word, count(*) AS n FROM w GROUP BY word"""
)
def sc_title_words(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).select(F.explode(title_words(F.col("position_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: What a page says whose posting is gone; searched without case in the first 8,000 characters of the page's text.
GONE = (
    "job (?:posting |opening )?(?:was |is )?not found",
    "(?:position|job|posting|opening|role) (?:is |has been |was )?(?:no longer|not) (?:available|active|open|accepting)",
    "no longer accepting applications",
    "this (?:job|position|posting|listing) (?:has been )?(?:closed|filled|removed|expired)",
    "position has been filled",
    "page (?:you(?:'| a)re looking for )?(?:could not be found|doesn'?t exist|cannot be found|was not found)",
    "sorry.{0,40}(?:job|page|posting).{0,40}(?:not found|no longer exists|doesn'?t exist)",
)
#: What a page says that wants an account.
ACCOUNT = (
    "h-?captcha|re-?captcha|turnstile",
    "(?:sign|log) ?in to (?:apply|continue|your account)",
    "create (?:an? )?(?:candidate )?account(?: to apply)?",
    "(?:candidate|applicant) (?:login|sign ?in|home|portal|dashboard)",
)


def soft_not_found(text: Column) -> Column:
    """Whether a page's text says that the posting is gone."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 8000).rlike("(?i)" + "|".join(GONE))


def requires_account(html: Column, text: Column) -> Column:
    """Whether a page wants an account, by its markup or its text."""
    merged = F.concat(F.substring(F.coalesce(html, F.lit("")), 1, 200_000), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 8000))
    return merged.rlike("(?i)" + "|".join(ACCOUNT))
