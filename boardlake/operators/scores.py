"""Match scores that are kept: a pass scores what has no score yet for the résumé as it is now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlake.functions.enrich import DEMANDS, with_line
from boardlake.operators.matching import RESUMES, demands, scored, stems, words
from boardlake.operators.searchindex import _fs
from boardlake.registry import query
from boardlake.sources.folders import shared_folder
from boardlake.sources.postings import POSTINGS, postings

MOST_OVERLAP = 10
_SCORES = (
    "posting_id bigint, total int, matched int, match_percent double, unmatched array<string>, overlap array<string>, uploaded_at bigint, resume_key string"
)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All scores that passes have written; one of each posting, résumé and upload."""
    path, fs = _fs(spark, folder)
    return spark.read.schema(_SCORES).parquet(folder) if fs.exists(path) else spark.createDataFrame([], _SCORES)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest upload's score of each posting and résumé."""
    latest = Window.partitionBy("posting_id", "resume_key").orderBy(F.desc("uploaded_at"))
    return stored(spark, folder).withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")


def pending(described: DataFrame, resumes: DataFrame, scored: DataFrame) -> DataFrame:
    """posting_id, resume_key, uploaded_at without a score: new postings, late descriptions and changed résumés alike."""
    keys = F.broadcast(resumes.select("resume_key", "uploaded_at"))  # a user's few
    known = scored.select("posting_id", "resume_key", "uploaded_at")
    return described.select("posting_id").crossJoin(keys).join(known, ["posting_id", "resume_key", "uploaded_at"], "left_anti")


def overlap(every: Column, have: Column, most: int = MOST_OVERLAP) -> Column:
    """Words of a text (every) that a résumé has, the most frequent in the text first, then by name."""
    counted = F.transform(F.array_intersect(every, have), lambda w: F.struct((-F.size(F.filter(every, lambda x: x == w))).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda s: s["w"])


def score_pass(described: DataFrame, resumes: DataFrame, folder: str) -> DataFrame:
    """Score what is pending and append it to the scores in folder, by résumé; returns resume_key, scored.

    described has posting_id and job_description, resumes resume_key, text and uploaded_at. Descriptions of postings with nothing pending
    are not read into sections. A description is shuffled once, and its sections and words are read once for all résumés that wait for it.
    """
    spark = described.sparkSession
    due = pending(described, resumes, stored(spark, folder)).filter("posting_id is not null")
    waiting = due.groupBy("posting_id").agg(F.collect_list(F.struct("resume_key", "uploaded_at")).alias("_due"))
    text = F.col("job_description")
    told = resumes.select("resume_key", stems(F.col("text")).alias("_s"), F.array_distinct(words(F.col("text"))).alias("_have"))
    asked = told.agg(F.array_distinct(F.flatten(F.collect_list("_have"))).alias("_all"))  # of a description's words only these are ever counted
    read = described.join(waiting.hint("shuffle_hash"), "posting_id").crossJoin(F.broadcast(asked)).select(
        "posting_id", demands(text).alias("_d"), F.filter(words(text), lambda w: F.array_contains("_all", w)).alias("_w"), "_due"
    )
    pairs = read.select("posting_id", "_d", "_w", F.explode("_due").alias("_due")).select("posting_id", "_d", "_w", "_due.resume_key", "_due.uploaded_at")
    pairs = pairs.join(F.broadcast(told), "resume_key").withColumn("overlap", overlap(F.col("_w"), F.col("_have")))
    place = f"{folder}-new"
    scored(pairs, "overlap", "uploaded_at").select(*[c.split()[0] for c in _SCORES.split(", ")]).write.mode("overwrite").parquet(place)
    new = spark.read.schema(_SCORES).parquet(place)  # read once more by the append and the count, not computed again
    new.write.mode("append").partitionBy("resume_key").parquet(folder)
    return new.groupBy("resume_key").agg(F.count("*").alias("scored"))


@query(
    f"""WITH {POSTINGS}, n AS (SELECT count(*) AS every, count(*) FILTER (posting_id % 2 = 0) AS half FROM postings)
SELECT 1 AS pass, k AS resume_key, half AS scored FROM n, (VALUES ('baker'), ('driver')) r(k) UNION ALL SELECT 2, k, every - half FROM n, (VALUES ('baker'), ('driver')) r(k) UNION ALL SELECT 3, 'driver', every FROM n"""
)
def sr_score_passes(spark, sf_dir) -> DataFrame:
    """What three passes score: half of the postings, then all, then all again for the one résumé that has changed."""
    df, folder = with_line(postings(spark, sf_dir), DEMANDS).select("posting_id", "job_description"), f"{shared_folder(spark)}/scores"
    uploads = lambda at: spark.createDataFrame([(k, t, at if k == "driver" else 1) for k, t in RESUMES], "resume_key string, text string, uploaded_at bigint")
    told = []
    for i, (rows, at) in enumerate(((df.filter("posting_id % 2 = 0"), 1), (df, 1), (df, 2)), 1):
        told += [(i, r.resume_key, r.scored) for r in score_pass(rows, uploads(at), folder).collect()]  # one row a résumé
    return spark.createDataFrame(told, "pass int, resume_key string, scored bigint")
