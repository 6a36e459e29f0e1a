"""Queries do their whole job: what smaller versions of them left out."""

import duckdb

from boardlake.llm import queries
from tests.llm import plain


def test_line_dedup_takes_short_lines(spark, tmp_path):
    lines = [
        "Menu", "one two three four five", "one two three four", "one two three four five six", "one two odd four five", "a b", "", " ", "menu\t",
        "p q r s t u v w x", "p q r s t u v w", "zero two three four five", "q r s t u v w x", "A b", "a c", "one two three four", "x y z p q", "x z p q",
    ]
    rows = [(1, "\n".join(lines)), *((i + 2, x) for i, x in enumerate(lines)), (90, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.text_sha256) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    assert found == {
        d: (len((texts[d] or "").split("\n")) - len(x), plain.hexed("\n".join(x).encode())) for d, x in plain.left_lines(rows).items()
    }


def test_links_of_each_document(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base)), (500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a c")]
    for i in range(1, 170):  # more than a block of near copies, some not linked to each other, and copies of them
        w = list(base)
        for k in range(i % 9):
            w[(i * 13 + k * 17) % 200] = f"v{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[6 + i % 5][1]) for i in range(20)]
    rows += [(300 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))) for i in range(12)]
    rows += [(400 + i, " ".join(base[:110]) + " " + " ".join(f"u{i}_{j}" for j in range(60 + i))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op6_ngram_jaccard_links(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(queries.ORACLE_SQL["op6_ngram_jaccard_links"])
    assert out.columns == [c[0] for c in want.description]
    found = sorted(tuple(r) for r in out.collect())
    assert found == sorted(want.fetchall()) and len({r[3] for r in found}) > 5
    assert queries.partenum.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
