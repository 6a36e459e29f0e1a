"""Inputs on which queries once differed from their SQL or outgrew their limits."""

import duckdb
from pyspark.sql import functions as F

from boardlake import catalog
from boardlake.functions import dates, enrich
from boardlake.sources import inspection

NOW = 1_706_659_200


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given frames."""
    duck = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns)
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want.fetchall()))


def test_a_day_that_last_year_lacks_is_no_date(spark):
    df = spark.createDataFrame([("February 29",), ("Feb 28",), ("March 1",)], "x string")
    assert [r.v for r in df.select(dates.posting_epoch(F.col("x"), NOW).alias("v")).collect()] == [None, 1_677_542_400, 1_677_628_800]


def test_milliseconds_of_late_days_are_read(spark, tmp_path):
    """Ids past 97,207 make epochs of 11 and 12 digits, whose milliseconds have 14 and 15."""
    ids = [*range(97_200, 97_236), *range(600_000, 600_018), *range(11_553_790, 11_553_808)]
    got, want = against_sql(spark, tmp_path, "dt_forms", documents=spark.createDataFrame([(k,) for k in ids], "doc_id bigint"))
    assert len(want) == len(ids) and got == want
    df = spark.createDataFrame([("1700000000999",), ("999999999999999",), ("1700000000000000",)], "x string")
    assert [r.v for r in df.select(dates.posting_epoch(F.col("x"), NOW).alias("v")).collect()] == [1_700_000_000, 999_999_999_999, None]


def test_signals_of_a_page_are_of_the_text_that_is_kept(spark, tmp_path):
    page = "<html><body><p>" + "long words " * 6000 + "</p></body></html>"
    got, want = against_sql(spark, tmp_path, "tx_page_signals", pages=spark.createDataFrame([(1, page), (2, page + page), (3, "<p>x</p>")], "page_id bigint, html string"))
    assert got == want


def test_best_rows_leave_no_row_for_each_pair(spark):
    """Blocks, parts, ties and a compaction against plain Python; the shuffled rows are a question's best alone."""
    import random

    from boardlake.operators import nearest

    rnd = random.Random(7)
    rows = {k: sorted(rnd.sample("abcdefghij", rnd.randint(1, 6))) for k in range(700)}
    asks = {k: rows[k] for k in range(0, 700, 50)}
    as_rows = lambda d, name: spark.createDataFrame([(k, v, [1.0] * len(v)) for k, v in d.items()], f"{name} long, terms array<string>, weights array<double>")
    met = nearest.dealt(as_rows(asks | {None: ["a"]}, "asked"), as_rows(rows | {None: ["a"]}, "key"), 3, 4)
    got = {(r.asked, r.key, int(r.score)) for r in nearest.best(met, 9).collect()}
    want = set()
    for a, terms in asks.items():
        found = [(-len(set(terms) & set(v)), k) for k, v in rows.items() if k != a and set(terms) & set(v)]
        want |= {(a, k, -n) for n, k in sorted(found)[:9]}
    assert got == want
    assert nearest.best(nearest.dealt(as_rows({}, "asked"), as_rows(rows, "key"), 1, 2), 9).count() == 0


def by_blocks(spark, folder, monkeypatch, name):
    """The query against its SQL with blocks of two questions and parts of 150 rows; how many blocks' results were written."""
    from boardlake.operators import nearest
    from tests.test_searchindex import PUBLISHED

    seen, written = [], nearest.written
    for what, value in (("ASKED_AT_ONCE", 2), ("ROWS_AT_ONCE", 150), ("written", lambda df: seen.append(df.columns) or written(df))):
        monkeypatch.setattr(nearest, what, value)
    texts = [(k, " ".join(PUBLISHED[(k * 7 + i * i) % len(PUBLISHED)] for i in range(k % 23)), "en", "web", 4) for k in range(420)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    part = spark.createDataFrame([(k, "red", "tin") for k in range(200)], "p_partkey bigint, p_name string, p_type string")
    got, want = against_sql(spark, folder, name, documents=documents, part=part)
    assert len(want) > 500 and got == want
    return len([columns for columns in seen if "score" in columns])


def test_terms_of_found_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Not a row's terms for each question that found it, nor for each block of the questions."""
    from boardlake.operators import nearest

    assert by_blocks(spark, tmp_path, monkeypatch, "sr_overlap_terms") >= 2
    rows = spark.createDataFrame([(k, ["a", "b", "c"]) for k in range(9)], "key bigint, terms array<string>")
    asks = spark.createDataFrame([(100, ["c", "a"]), (200, ["x"])], "asked bigint, terms array<string>")
    pairs = spark.createDataFrame([(100, k, 2.0) for k in range(8)] + [(200, 3, 0.0)], "asked bigint, key bigint, score double")
    told = nearest.common(asks, pairs, rows, 3, 1)
    assert {tuple(r) for r in told.collect()} == {(100, k, 2.0, "a") for k in range(8)} | {(200, 3, 0.0, "")}
    assert "Join" not in told._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")


def test_similar_postings_come_by_blocks_in_turn(spark, tmp_path, monkeypatch):
    """All rows of the index were dealt once for each block of questions."""
    assert by_blocks(spark, tmp_path, monkeypatch, "sr_similar") >= 2


def test_each_slot_is_a_task_of_its_own(spark):
    """Slots dealt by their hash left tasks without one and gave others several."""
    from boardlake.operators import nearest

    rows = spark.createDataFrame([(k, ["a"], [1.0]) for k in range(300)], "key bigint, terms array<string>, weights array<double>")
    met = nearest.dealt(rows.filter("key < 9").withColumnRenamed("key", "asked"), rows, 3, 4)
    held = met.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("slot").alias("n")).collect()
    assert sorted(r.n for r in held) == [1] * 12


def test_words_by_count(spark):
    from boardlake.operators.relevance import by_count

    rows = spark.createDataFrame([(["b", "a", "c", "b", "c", "b"],), ([],), (["x"],)], "w array<string>")
    assert [r.t for r in rows.select(by_count(F.col("w")).alias("t")).collect()] == [["b", "c", "a"], [], ["x"]]


def test_sections_are_read_once_for_each_posting(spark):
    """Résumés made by a session are of unknown size, so that Spark on its own dealt both sides and read each section again for each part."""
    from boardlake.operators.matching import match_scores, resumes

    rows = spark.createDataFrame([(1, "x\nRequirements:\n- Forklift license and steady hands")], "posting_id bigint, job_description string")
    made = match_scores(rows, resumes(spark))
    assert "CartesianProduct" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.resume_key, r.total, r.matched) for r in made.collect()} == {("baker", 1, 0), ("driver", 1, 1)}


def test_sections_begin_at_the_first_head_that_opens_one(spark):
    from boardlake.functions.enrich import sections

    text = "Benefits\n- A bullet before any head at all\n" + "Requirements and " + "x" * 90 + "\n \t \n  Requirements:\r\n- Forklift license and steady hands\nBenefits\n- Free lunches on every day\nWhat you'll do\nWork on all of the things.\n"
    rows = spark.createDataFrame([(1, text), (2, "No head.\n- A bullet of twenty letters"), (3, None), (4, "Requirements:")], "k int, t string").select("k", sections(F.col("t")).alias("s"))
    assert {r.k: (r.s.responsibilities, r.s.requirements) for r in rows.collect()} == {
        1: (["Work on all of the things."], ["Forklift license and steady hands"]), 2: ([], []), 3: ([], []), 4: ([], []),
    }


def test_pending_scores_are_no_product_of_parts(spark):
    from boardlake.operators.scores import pending, stored

    rows = spark.createDataFrame([(1,), (2,)], "posting_id bigint")
    resumes = spark.createDataFrame([("a", 1), ("b", 1)], "resume_key string, uploaded_at bigint")
    due = pending(rows, resumes, stored(spark, "/tmp/there-is-no-such-folder"))
    assert "CartesianProduct" not in due._jdf.queryExecution().executedPlan().toString()
    assert due.count() == 4


def test_a_brief_reads_the_resume_once(spark):
    """Not again for each word of each posting."""
    from boardlake.operators.upkeep import brief

    resume = "Forklift license holder with steady hands\nLedger work of many years in the red plant"
    rows = spark.createDataFrame([(1, "Requirements:\n- Forklift license and steady hands\n- Knowledge of ledger software\nledger"), (2, None)], "posting_id bigint, job_description string")
    made = brief(rows, resume)
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Forklift" in x and "job_description" in x]
    got = {r.posting_id: (r.overlap_terms, r.resume_evidence, r.unmatched_requirements) for r in made.collect()}
    assert got[1] == (["ledger", "forklift", "hands", "license", "steady"], [resume.split("\n")[0], resume.split("\n")[1]], [])
    assert got[2][0] is None


def test_index_counts_a_posting_in_its_row(spark, tmp_path):
    """No row for each word is shuffled; an id that comes twice is one posting, and one without words counts too."""
    import pyarrow as pa

    from boardlake.functions.stem import stem, stem_word
    from boardlake.operators import searchindex
    from tests.test_searchindex import KIND, PUBLISHED

    part = pa.RecordBatch.from_pydict({"key": [1, 2], "position_name": [["tools", "tool"], []], "company_name": [["tools"], []], "job_description": [["c++", "tools"], []]})
    part = part.cast(pa.schema([("key", pa.int64()), *[(f, pa.list_(pa.string())) for f in ("position_name", "company_name", "job_description")]]))
    got = [tuple(r.values()) for b in searchindex._counted(iter([part])) for r in b.to_pylist()]
    assert sorted(got, key=str) == [(1, 5, "c++", 0, 0, 1), (1, 5, "tool", 2, 1, 1), (1, 5, None, 0, 0, 0), (2, 0, None, 0, 0, 0)]
    words = [*PUBLISHED, "yyed", "saying", "eed", "lled", "tttion", "aies", "y", "zzz"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert [(r.w, r.s) for r in rows] == [(w, stem_word(w)) for w in words]
    twice = spark.createDataFrame([(1, "a", "b", "tools here"), (1, "a", "b", "tool here")], KIND)
    assert searchindex.add(twice, str(tmp_path / "i"))["indexed"] == 1
    assert {(r.term, r.job_description) for r in searchindex.terms(spark, str(tmp_path / "i")).collect()} == {("tool", 2), ("here", 2)}


#: Lines with `rate` inside a word and numbers that are no pay: a card's, an address, a version, beside marks that belong to the word before them.
NO_PAY = ("Therater$$$ 4443578346646849$$$ iner***", "Onorea$ 170.116.163.254 therater", "Iner$$$ 3.%%% therater", "An<b>on$$</b>$ 1142126282388588 erater")


def test_inspection_fills_in_no_pay_from_other_numbers(spark, tmp_path):
    keys = (5, 25, 50, 70)
    documents = spark.createDataFrame([(k, "text", "en", "web", 4) for k in keys], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    part = spark.createDataFrame([(k, "red", "tin") for k in keys], "p_partkey bigint, p_name string, p_type string")
    pages = spark.createDataFrame([(k, f"<html><body><p>{x}</p></body></html>") for k, x in zip(keys, NO_PAY, strict=True)], "page_id bigint, html string")
    got, want = against_sql(spark, tmp_path, "m_apply_inspection", documents=documents, part=part, pages=pages)
    assert len(want) == 4 and got == want


def test_an_inspected_page_states_no_pay_by_other_numbers(spark, tmp_path):
    paid = "<html><body><div class='job-description'>" + "<p>Words of the job.</p>" * 20 + "<p>{}</p></div></body></html>"
    pages = [(k, paid.format(x)) for k, x in zip((5, 7, 13, 14), NO_PAY, strict=True)]
    rows = spark.createDataFrame(pages, "page_id bigint, html string")
    got, want = against_sql(spark, tmp_path, "tx_inspect_pages", pages=rows)
    assert len(want) == 4 and got == want
    inspected = inspection.inspect_pages(spark.createDataFrame([(1, 200, paid.format("Rate$$$ 170.1.2.3 or $ 30 an hour"))], "posting_id bigint, http_status int, html string"))
    assert [tuple(r.pay) for r in inspected.collect()] == [(30.0, 30.0, "hour", "$ 30")]


def test_pay_of_a_line_is_no_other_number(spark, tmp_path):
    documents = spark.createDataFrame([(k, x, "en", "web", 4) for k, x in enumerate(NO_PAY * 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    part = spark.createDataFrame([(k, "red", "tin") for k in range(12)], "p_partkey bigint, p_name string, p_type string")
    got, want = against_sql(spark, tmp_path, "tx_pay_from_prose", documents=documents, part=part)
    assert len(want) == 12 and got == want
    told = {
        "Pay: $$$ 3. or $20": 20.0, "pay: $$120,000": 120_000.0, "CAD$ 50 rate": 50.0, "wage $ 20.": 20.0, "Salary $60,000.Apply": 60_000.0, "salary $1,000,000,000": 1e9, "pay $123456789": 123_456_789.0,
        "pay $1234567890": None, "pay $1,2345 per hour": None, "pay $1.2.3": None, "pay: 9123,456 to 200,000": None, "salary...100,000 to 120,000": 100_000.0,
    }
    rows = spark.createDataFrame([(x,) for x in told], "x string").select("x", enrich.pay_from_prose(F.col("x")).alias("p")).collect()
    assert {r.x: r.p and r.p.pay_min for r in rows} == told


def test_signatures_are_shuffled_many_a_row(spark):
    """Not a row for each; those that two sets share come out of their slot with their number, as a plain count has them."""
    import numpy as np

    from boardlake.llm import partenum

    texts = [" ".join(f"w{(i * i + k // 3 * 5) % 97}" for i in range(30 + 11 * (k // 3))) + " end" * (k % 3) for k in range(45)]
    texts += [texts[5], texts[8], "one two", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sets = {partenum._prints(h)[0]: h for h in partenum.shingles(texts) if len(h)}
    for bits in (0, 4, 9):
        every = {}
        for above in (0, 1):
            sig, of, tag = partenum.signatures(list(sets.values()), above)
            for x, a, t in zip((sig >> max(0, 8 - bits)).tolist(), np.array(list(sets))[of].tolist(), tag.tolist(), strict=True):
                every.setdefault(x, set()).add((a, t))
        want = {(x, a, t) for x, members in every.items() if len({a for a, _ in members}) > 1 for a, t in members}
        packed = partenum._packed(df, bits)
        got = {(r._sig, r._a, r._tag) for r in partenum._shared(packed, bits).collect()}
        assert want and got == want
        assert bits > 4 or packed.count() <= 3 << bits < sum(map(len, every.values())) / 2
    assert [partenum._slot_bits(n) for n in (0, 3_000_000, 500_000_000, 8_000_000_000)] == [0, 2, 6, 9]
