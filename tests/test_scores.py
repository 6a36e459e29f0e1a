"""Scores that are kept: only what is pending is scored, and the latest upload counts."""

from boardlake.operators import scores

NEED = "Requirements:\n- Forklift license and steady hands\n- Knowledge of ledger software\n"


def test_a_changed_resume_alone_is_scored_again(spark, tmp_path):
    folder = str(tmp_path / "scores")
    rows = spark.createDataFrame([(1, NEED), (2, NEED + "forklift Forklift ledger"), (3, None)], "posting_id long, job_description string")
    kind = "resume_key string, text string, uploaded_at bigint"
    old = spark.createDataFrame([("a", "forklift license", 1), ("b", "ledger software knowledge", 1)], kind)
    new = spark.createDataFrame([("a", "forklift license, ledger software knowledge", 2), ("b", "ledger software knowledge", 1)], kind)
    told = lambda df: {r.resume_key: r.scored for r in df.collect()}
    assert told(scores.score_pass(rows.filter("posting_id = 1"), old, folder)) == {"a": 1, "b": 1}
    assert told(scores.score_pass(rows, old, folder)) == {"a": 2, "b": 2}
    assert told(scores.score_pass(rows, new, folder)) == {"a": 3}
    assert told(scores.score_pass(rows, new, folder)) == {}
    now = {(r.posting_id, r.resume_key): (r.matched, r.total, r.overlap) for r in scores.current(spark, folder).collect()}
    assert now[2, "a"] == (2, 2, ["forklift", "ledger", "knowledge", "license", "software"])
    assert now[2, "b"] == (1, 2, ["ledger", "knowledge", "software"])
    assert now[3, "a"] == (0, 0, None) or now[3, "a"][1] == 0
    assert scores.stored(spark, folder).count() == 9
