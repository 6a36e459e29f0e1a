"""Résumés against requirements: stems, gaps and scores of each pair of posting and résumé."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import CORPUS_STOPWORDS
from boardlake.functions.enrich import DEMANDS, sections, with_line
from boardlake.functions.text import raw_tokens, tokens
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

# Words without meaning of their own.
FUNCTION_WORDS = (
    "the and for with you your our are will that this have has had from not but all can who was were been their them they its into out about over "
    "under more most other such than then there these those some any each how what when where which while would should could may might must per via "
    "etc also one two three able both very well here just own get got way use using used including include"
).split()
# Fixed value: demands on temper, which no résumé answers.
SOFT = (
    "(?i)bias (towards|toward)|hands dirty|open to feedback|fast[- ]paced|ambiguity|ambiguous|self[- ]starter|team player|passionate|thrive|crave|hustle"
    "|scrappy|curious|humble|energy|attitude|work ethic|willing to learn|detail[- ]oriented|communication skills"
)


def words(text: Column) -> Column:
    """Tokens but for function words."""
    return F.filter(raw_tokens(text), lambda w: ~w.isin(FUNCTION_WORDS))


def stems(text: Column) -> Column:
    """Distinct words cut to six letters."""
    return F.array_distinct(F.transform(words(text), lambda w: F.substring(w, 1, 6)))


def gaps(demands: Column, resume_stems: Column, strict: bool) -> Column:
    """Demands that a résumé doesn't meet: no shared stem, or with strict fewer than two (one where
    the demand has but one word). Soft demands and those without words are left out."""
    real = F.filter(demands, lambda d: ~d.rlike(SOFT) & (F.size(words(d)) > 0))
    if not strict:
        return F.filter(real, lambda d: ~F.arrays_overlap(stems(d), resume_stems))
    met = lambda d: F.size(F.filter(words(d), lambda w: F.array_contains(resume_stems, F.substring(w, 1, 6))))
    return F.filter(real, lambda d: met(d) < F.when(F.size(words(d)) == 1, 1).otherwise(2))


def demands(text: Column) -> Column:
    """What a description asks for, but for soft demands and those without words."""
    return F.get(F.transform(F.array(sections(text)["requirements"]), lambda every: F.filter(every, lambda d: ~d.rlike(SOFT) & (F.size(words(d)) > 0))), F.lit(0))


def match_scores(described: DataFrame, resumes: DataFrame) -> DataFrame:
    """For each posting and résumé (resume_key, text; a handful): demands, those met, percent, gaps.

    Sections are read once for each posting; résumés come as rows of stems, broadcast, as a join that deals both sides would read
    the sections again for each part of the résumés.
    """
    told = resumes.select("resume_key", stems(F.col("text")).alias("_s"))
    return scored(described.select("posting_id", demands(F.col("job_description")).alias("_d")).crossJoin(F.broadcast(told)))


def scored(pairs: DataFrame, *more: str) -> DataFrame:
    """Scores of rows of posting_id, resume_key, demands _d and a résumé's stems _s; more names columns that stay."""
    out = pairs.withColumn("unmatched", gaps(F.col("_d"), F.col("_s"), True)).withColumn("total", F.size("_d"))
    matched = F.col("total") - F.size("unmatched")
    return out.select(
        "posting_id", "resume_key", "total", matched.alias("matched"),
        F.when(F.col("total") > 0, matched * 100.0 / F.col("total")).cast("double").alias("match_percent"), F.slice("unmatched", 1, 5).alias("unmatched"), *more,
    )


RESUMES = [("baker", "Night crew lead, widget assembly, red ledgers of software"), ("driver", "Forklift license holder with steady hands")]


def resumes(spark) -> DataFrame:
    return spark.createDataFrame(RESUMES, "resume_key string, text string")


_SCORES = """a(r, resume_key, total, matched, gap) AS (VALUES (0, 'baker', 2, 2, ''), (0, 'driver', 2, 0, 'Five years of red widget assembly|Knowledge of ledger software'),
(1, 'baker', 0, 0, ''), (1, 'driver', 0, 0, ''), (2, 'baker', 1, 0, 'Forklift license and steady hands'), (2, 'driver', 1, 1, ''))"""


@query(
    f"""WITH {POSTINGS}, {_SCORES} SELECT posting_id, resume_key, total, matched, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total END AS match_percent, gap AS unmatched
FROM postings JOIN a ON posting_id % 3 = r"""
)
def sr_match_scores(spark, sf_dir) -> DataFrame:
    scores = match_scores(with_line(postings(spark, sf_dir), DEMANDS), resumes(spark))
    return scores.withColumn("unmatched", F.array_join("unmatched", "|"))


@query(
    f"""WITH {POSTINGS}, {_SCORES} SELECT posting_id, max(CASE WHEN resume_key = 'baker' THEN matched * 100.0::DOUBLE / nullif(total, 0) END) AS baker,
max(CASE WHEN resume_key = 'driver' THEN matched * 100.0::DOUBLE / nullif(total, 0) END) AS driver,
CASE WHEN posting_id % 3 = 1 THEN 'no_requirements_detected' ELSE 'scored' END AS match_status FROM postings JOIN a ON posting_id % 3 = r GROUP BY 1"""
)
def jn_score_map(spark, sf_dir) -> DataFrame:
    """All résumés' scores of a posting as one map."""
    scores = match_scores(with_line(postings(spark, sf_dir), DEMANDS), resumes(spark))
    of = scores.groupBy("posting_id").agg(F.map_from_entries(F.collect_list(F.struct("resume_key", "match_percent"))).alias("m"), F.max("match_percent").alias("best"))
    return of.select(
        "posting_id", F.col("m")["baker"].alias("baker"), F.col("m")["driver"].alias("driver"),
        F.when(F.col("best").isNull(), "no_requirements_detected").otherwise("scored").alias("match_status"),
    )


_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in CORPUS_STOPWORDS) + ")"
_WORDS = f"""list_filter(list_transform(string_split(regexp_replace(lower(text), '[^a-z0-9+#-]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^[+#-]+|[+#-]+$', '', 'g')),
lambda w: length(w) BETWEEN 3 AND 30 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {_STOP})"""


@query(
    f"""WITH t AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS n FROM t GROUP BY 1, 2)
SELECT item_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 60"""
)
def sr_query_terms(spark, sf_dir) -> DataFrame:
    """Sixty terms of each text, by count and then by name."""
    from pyspark.sql import Window

    counts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "term")).cast("long")
    return counts.withColumn("rank", rank).filter("rank <= 60")
