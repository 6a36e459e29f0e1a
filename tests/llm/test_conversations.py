"""Repair, embedding near-dedup and prefix trie on odd rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake.llm import queries, repair, trie, vectors
from tests.llm import plain

TURNS = "conv_id long, turn long, role string, text string, _conv string, _pos string, _row string, _copies_ string, _said string, _h string, kept string"
VECTORS = "vec_id long, embedding array<float>, label int, _vec string, _node string, _comp string, _n string, kept string"


def _rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["yes.", "no!", "well", "", " ", None, "a b?", "é…", "long " * 5000 + "."]
    rows = [(c, t, roles[rng.randrange(3) if rng.random() < 0.8 else rng.randrange(7)], rng.choice(texts)) for c in range(40) for t in range(rng.randrange(9)) if rng.random() < 0.9]
    rows += [(5, None, "user", "first."), (5, None, "assistant", "too."), (5, 3, "user", "tie."), (5, 3, "user", "tie."), (6, None, None, None)]
    rows += [(None, 1, "user", "nobody."), (None, 2, "assistant", "nothing."), (-7, 1, "user", "below."), (-8, 0, "user", "zero")]
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t % 50}.") for t in range(400)]
    rows += [(101, t, "user" if t % 3 else "system", f"turn {t}.") for t in range(300)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same.") for c in range(200, 260) for t in range(12)]
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    rows = _rows()
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], TURNS).repartition(6), rows


@pytest.fixture(scope="module")
def silence(spark):
    return spark.createDataFrame([], TURNS)


def test_lattice():
    rng = random.Random(4)
    for _ in range(3000):
        rows = [(rng.choice("suauaua x"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(1, 10))]
        assert repair.cheapest(rows, 0, repair.WHOLE) == plain.op11_edits(rows)
    assert repair.cheapest([], 0, repair.WHOLE) == (0, "")


def test_lattice_in_pieces():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("suauaua x"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(2, 12))]
        joined, cuts = repair._Joined(), sorted(rng.sample(range(1, len(rows)), rng.randrange(1, min(4, len(rows)))))
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            ways = [(p, q, repair.cheapest(rows[a:b], p, (q,))) for p in range(4) for q in range(4)]
            told = [{"before": p, "after": q, "cost": c, "audit": t} for p, q, (c, t) in ways if c < float("inf")]
            joined.add({"ways": told, "low": None, "final": "", "initial": "", **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)})
        assert joined.end() == plain.op11_edits(rows)


@pytest.mark.parametrize("most", [repair.ROWS, 7])
def test_repair(talk, silence, most):
    df, rows = talk
    assert {r.conv_id: tuple(r)[1:] for r in repair.report(df, most).collect()} == plain.op11(rows)
    assert repair.report(silence).count() == 0


def test_no_rows_left(spark):
    gone = next(c for c in range(10_000) if plain.zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = repair.report(spark.createDataFrame([(gone, 1, "user", "all.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", plain.hexed(b""))]


def test_repaired_turns(talk):
    df, rows = talk
    some = df.filter("conv_id < 40 or conv_id = 100")
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.repair(some).collect()}
    made = {}
    for r in repair.repaired_turns(some).orderBy("conv_id", "position").collect():
        made.setdefault(r.conv_id, []).append((r.edit, f"{r.role}:{r.text}"))
    for c, (audit, sha) in digests.items():
        left = made.get(c, [])
        assert "".join(e for e, _ in left) == audit.replace("D", "")
        assert plain.hexed("\n".join(t for _, t in left).encode()) == sha


def test_trie(talk, silence, monkeypatch):
    df, rows = talk
    monkeypatch.setattr(trie, "BLOCK", 16)
    want = plain.op13([r for r in rows if r[0] is None or r[0] >= 0])
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.rebuilt_trie(df.filter("conv_id is null or conv_id >= 0")).collect()}
    assert found == want
    assert trie.rebuilt_trie(silence).count() == 0


def test_turnless_rebuilt_conversations_end_at_the_root(spark):
    none_left = [c for c in range(1, 400) if c % 5 and plain.zlib.crc32(str(c).encode()) % 9 > 0][:3]
    rows = [(c, 1, "user", "mine.") for c in none_left]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.rebuilt_trie(df).collect()}
    assert found == plain.op13(rows) == {(none_left[0], 0): (None, 3, 0, 1, 0, plain.hexed(",".join(map(str, none_left)).encode()))}


def test_trie_as_it_is(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "assistant", "c"), (3, 1, "user", "a")]
    found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    assert sorted(map(tuple, told.collect())) == [(1, 0, None, 3, 1, 2, 2) if d == 0 else r for d, r in enumerate([None, (1, 1, 1, 3, 2, 2, 2), (1, 2, 1, 1, 0, 1, 0), (2, 2, 1, 1, 0, 1, 0)])]


def test_contraction_of_random_trees(spark):
    """A chain, a tree that is nearly one and a bushy one, as one forest."""
    rng, rows, want = random.Random(6), [], {}
    for tree, shape in enumerate((1, 3, 150)):
        up = {0: None, **{i: rng.randrange(max(0, i - shape), i) for i in range(1, 150)}}
        names = dict(zip(up, rng.sample(range(10_000), len(up)), strict=True))
        here = [(tree * 10_000 + names[i], None if p is None else tree * 10_000 + names[p], rng.randrange(5), i) for i, p in up.items()]
        want |= {n: [a, b] for n, _, a, b in here}
        for n, p, *_ in reversed(here):
            if p is not None:
                want[p] = [x + y for x, y in zip(want[p], want[n], strict=True)]
        rows += here
    tree = spark.createDataFrame(rows, "_id long, _parent long, _a long, _b long")
    assert {r._id: [r._a, r._b] for r in trie.subtree_totals(tree).collect()} == want


def _vectors():
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(150)]
    for i in range(60):  # cosines around the limit and near copies, some scaled
        base, noise = rows[rng.randrange(20)][1], rng.choice([0.01, 0.3, 0.45, 0.5])
        rows.append((200 + i, [(x + noise * rng.gauss(0, 1)) * rng.choice([1, 7]) for x in base] if i % 2 else [x + noise * rng.gauss(0, 1) for x in base]))
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(3, rows[3][1]), (3, rows[9][1]), (None, rows[4][1]), (None, rows[200][1]), (None, None)]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] + [1.0] * 11), (404, [float("inf")] + [1.0] * 11), (405, [None] + [1.0] * 11)]
    rows += [(406, [1.0, 2.0]), (407, [1.0, 2.1]), (408, [-1.0, 2.0]), (409, [-0.0] + [1.0] * 11), (410, [0.0] + [1.0] * 11), (411, [1e30] * 12), (412, [1e-30] * 12)]
    return rows


@pytest.fixture(scope="module")
def points(spark):
    df = spark.createDataFrame([(*r, 1, *["clash"] * 5) for r in _vectors()], VECTORS).repartition(5)
    return df, [(r.vec_id, r.embedding) for r in df.collect()]


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("cells", [(1,), (4,)])
def test_vectors(points, spark, cells, monkeypatch):
    df, rows = points
    monkeypatch.setattr(vectors, "CELLS", cells)
    monkeypatch.setattr(vectors, "SENT", 0)
    found = vectors.near_duplicates(df)
    assert _sorted(found.select("vec_id", "n_links", "component_id").collect()) == _sorted(plain.op12(rows))
    assert found.filter(~F.col("kept").eqNullSafe(F.col("vec_id").eqNullSafe(F.col("component_id")))).isEmpty()
    empty = vectors.near_duplicates(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0
    assert empty.columns == found.columns


def test_vectors_in_lanes(points):
    df, rows = points
    assert _sorted(vectors.near_duplicates(df, side=40).select("vec_id", "n_links", "component_id").collect()) == _sorted(plain.op12(rows))


def test_cells_of_clustered_vectors_prune_and_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(8)
    heads = vectors.unit(rng.normal(size=(40, 24)))
    x = vectors.unit(heads[rng.integers(0, 40, 4000)] + 0.06 * rng.normal(size=(4000, 24)))
    found = vectors.fitted(x[:2000], 10_000_000, 0.9)
    home, row, cell = vectors.places(x, found, 0.9)
    assert len(found) > 1
    assert len(row) < 3 * len(x)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    met = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert all(home[a] == home[b] or ((a, home[b]) in met if home[a] < home[b] else (b, home[a]) in met) for a, b in zip(i.tolist(), j.tolist(), strict=True))


def test_sql():
    """The SQL against plain Python on whole tables; the driver of queries holds the queries against the SQL."""
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    told = {name: con.execute(queries.ORACLE_SQL[name]).fetchall() for name in ("op11_structure_repair", "op12_embedding_dedup", "op13_prefix_trie")}
    assert {r[0]: r[1:] for r in map(tuple, told["op11_structure_repair"])} == plain.op11(rows)
    assert {r[:2]: r[2:] for r in map(tuple, told["op13_prefix_trie"])} == plain.op13(rows)
    points = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert _sorted(r[:3] for r in map(tuple, told["op12_embedding_dedup"])) == _sorted(plain.op12(points))
