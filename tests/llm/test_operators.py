"""Operators on a small fixture with nulls, empty and long texts, copies and clashing columns, against plain Python."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from boardlake.llm import bpe, chat, chunks, decontaminate, linededup, partenum, quality, rules, secrets, tokencounts, tokenfiles
from boardlake.llm.common import shared_dir
from tests.llm import plain

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PROSE = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(150))
ODD = [
    None, "", " ", "\n\n", "a", "A  b\t\tc \n d", "é" * 300, "x" * 5000, "  lead and trail  ", "it's 'Re <|endoftext|> end",
    PROSE, PROSE, PROSE.upper(), PROSE.replace("word3x", "other", 1), PROSE + "\n" + PROSE, "a b c", "A B c",
    "\x1c odd\x85space　here", 'password = "hunter2secret" AKIA' + "Z9" * 10 + " " + "0123456789abcdef" * 2 + "\npasswd: abc",
    "token=token:abcdef api-key apikey=abcdef", "one two three four five six seven eight " * 6,
    "same line of six words here\nother line of some six words\nsame line of six words here",
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _doc string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rows = sample + [(1000 + i, t) for i, t in enumerate(ODD)]
    data = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 1, "clash", "clash", None) for i, t in rows]
    return spark.createDataFrame(data, KIND).repartition(5), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def got(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bpe(docs, none):
    import tiktoken

    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        x = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        want[i] = (len(x) // 4, plain.hexed(x), plain.hexed((t or "").encode()))
    assert got(bpe.digests(df, RANKS, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0
    both = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())


def test_merge_is_leftmost_lowest():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    assert bpe.merge(b"aaaa", ranks) == [256, 256]
    assert bpe.merge(b"aaaab", ranks) == [256, 256, ord("b")]
    assert bpe.merge(b"aab", ranks) == [256, ord("b")]


def test_chunks_join_to_the_text():
    for t in filter(None, ODD):
        assert "".join(chunks.cut(t)) == t


def test_decontamination(spark, docs, none):
    df, rows = docs
    bench = [(1, rows[3][1][:300]), (2, PROSE), (3, "a b"), (4, ""), (5, None), (12, PROSE.upper()), (2, "A B c")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = plain.op2(rows, bench)
    assert got(decontaminate.report(df, b), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = {r.doc_id for r in decontaminate.remove(df, b).collect()}
    assert kept == {i for i, w in want.items() if not w[4]}
    assert decontaminate.remove(df, b).columns == df.columns
    assert decontaminate.report(none, b).count() == 0
    assert {x[1] for x in got(decontaminate.report(df, b.limit(0)), "n_words", "n_hit").values()} == {0}
    assert got(decontaminate.strip(df, b), "text") == {i: (plain.op2_left(t, bench),) for i, t in rows}
    assert decontaminate.strip(none, b).count() == 0 and decontaminate.remove(none, b).count() == 0
    many = "A b c d\n" * 40_000
    few = spark.createDataFrame([(1, None), (2, many), (2, many), (None, "A b"), (None, "")], "doc_id long, text string")
    assert sorted((r.text for r in decontaminate.strip(few, b).collect()), key=len) == ["", "", "", *[" ".join(["d"] * 40_000)] * 2]


def test_rules(docs, none):
    df, rows = docs
    want = plain.op5(rows)
    out = rules.quality(df)
    assert got(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = {i for i, (k,) in got(out, "kept").items() if k}
    assert kept and not any(want[i][5] for i in kept)
    good = rules.keep_good(df)
    assert {r.doc_id for r in good.collect()} == kept and good.columns == df.columns
    assert rules.quality(none).count() == 0 and rules.keep_good(none).count() == 0


def test_limits_follow_their_group(spark):
    """What is usual in one source is odd in another; the limit is the value at the metric's rank."""
    word = lambda i: f"w{i}"
    rows = []
    for source, usual in (("a", 0), ("b", 6)):
        for i in range(400):
            signs = usual + (i % 10) * (source == "b") + 9 * (i < 8)
            rows.append((len(rows), " ".join([*map(word, range(i, i + 60)), *["#"] * signs]), "en", source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    measured, c = rules.measure(df)
    most = {r["_source"]: r.asDict() for r in rules.limits(measured, c).collect()}
    share = lambda t: 1000 * t.count("#") // len(t.replace(" ", ""))
    for source in "ab":
        values = sorted(share(t) for _, t, _, s in rows if s == source)
        assert most[source]["_max_symbols"] == values[-(-950 * len(values) // 1000) - 1]
    assert most["a"]["_max_symbols"] == 0 < most["b"]["_max_symbols"]
    kept = {i for i, (k,) in got(rules.quality(df), "kept").items() if k}
    gone = {i for i, t, _, s in rows if share(t) > most[s]["_max_symbols"]}
    assert gone and not gone & kept and kept == {r.doc_id for r in rules.keep_good(df).collect()}


def test_jaccard_join(docs, none):
    df, rows = docs
    want = plain.op6(rows)
    assert got(partenum.report(df), "n_shingles", "component_id") == want
    kept = partenum.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i} and kept.columns == df.columns
    assert partenum.report(none).count() == 0


def test_jaccard_of_large_groups(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # near copies of one text, some far from the first
        w = list(base)
        for k in range(i % 9):
            w[(i * 13 + k * 17) % 200] = f"v{i}_{k}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"shared{i}" for i in range(60))  # a passage in many documents that aren't alike
    rows += [(200 + i, common + " " + " ".join(f"u{i}_{j}" for j in range(60 + i))) for i in range(60)]
    rows += [(300 + i, " ".join(f"c{i}_{j // (1 + i % 2)}" for j in range(i))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(partenum.report(df), "n_shingles", "component_id") == plain.op6(rows)


def test_chain_of_links(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 60))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.op6(rows)
    assert {c for _, c in want.values()} == {0}
    assert got(partenum.report(df), "n_shingles", "component_id") == want


def test_secrets(docs, none):
    df, rows = docs
    assert got(secrets.secrets(df), "n_assign", "n_access", "n_hex", "base_sha256") == plain.op7(rows)
    assert secrets.secrets(none).count() == 0


def test_owners_separate_copied_keys(spark):
    shared, own, many = "Abcdefghij1234567890", "Zyxwvutsrq0987654321", "Qwertyuiop1234512345"
    rows = [(1, f"see {shared}", "en", "a"), (2, f"see {shared} é", "en", "b"), (3, f"é {own} and {own}", "en", "a"), (None, f"{own}", None, "a")]
    rows += [(10 + i, f"{many} in {i}", "en", "a") for i in range(30)]  # one owner, but pasted everywhere
    rows += [(50, "token=onlyhere1", "en", "a"), (51, "token=sample99", "en", "a"), (52, "token=sample99", "en", "b")]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string")
    out = secrets.secrets(df)
    assert out.count() == len(rows) + 1
    assert got(out, "spans") == {
        1: ("",), 2: ("",), 3: ("owned:2:22,owned:27:47",), None: ("owned:0:20",), **{10 + i: ("",) for i in range(30)},
        50: ("assign:0:15",), 51: ("assign:0:14",), 52: ("assign:0:14",),
    }
    assert {d: x for d, x in got(out, "n_base_owned", "n_base_copied").items() if x != (0, 0)} == {50: (1, 0), 51: (0, 1), 52: (0, 1)}


def test_secrets_of_long_texts(spark):
    """Work grows with the matches: 100,000 of them in one text take seconds, not hours."""
    line = "0123456789abcdef01234567 token=abcdef"
    df = spark.createDataFrame([(1, "\n".join([line] * 100_000), "en", "a")], "doc_id long, text string, lang string, source string")
    (row,) = secrets.secrets(df).collect()
    assert (row.n_assign, row.n_access, row.n_hex) == (100_000, 0, 100_000)
    last = (len(line) + 1) * 99_999
    assert row.spans.endswith(f"hex:{last}:{last + 24},owned:{last}:{last + 24},assign:{last + 25}:{last + 37}")


def test_line_dedup(docs, none):
    df, rows = docs
    want = plain.op9(rows)
    assert got(linededup.report(df), "n_removed", "text_sha256") == {i: tuple(x) for i, x in want.items()}
    out = linededup.dedup(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r.text for r in out.collect() if r.doc_id == 1000} == {None}
    assert linededup.dedup(none).count() == 0


def test_line_dedup_of_long_texts(spark):
    text = "\n".join(f"line number {i % 50_000} of this long text" for i in range(100_000)) + "\n" + "word " * 50_000
    (row,) = linededup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "line number 0 of this long text\n" + "word " * 50_000


def test_near_lines(spark):
    w = [f"w{i}" for i in range(12)]
    swap = lambda i: " ".join(w[:i] + ["odd"] + w[i + 1 :])
    lines = [" ".join(w), swap(0), swap(11), " ".join(w[:5] + w[6:]), " ".join([*w, "more"]), " ".join(w[:3] + ["x", "y"] + w[5:]), " ".join(["a", *w[:10]]), "short line stays here", "short line stays here"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(50, "\n".join(lines)), (50, "\n".join(lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(linededup.report(df), "n_removed", "text_sha256") == {i: tuple(x) for i, x in plain.op9(rows[:-1]).items()}


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    df, rows = docs
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = shared_dir(spark)
    tokenfiles.write(df, P.path("byte_bpe_50k.json"), folder)
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got(tokenfiles.digests(tokenfiles.read(spark, folder)), "start", "n_tokens", "ids_crc32") == want
    odd = [(None, "b a"), (None, None), (-(2**63), "x"), (2**63 - 1, "y\0 z"), (7, "c"), (7, "c")]
    folder = shared_dir(spark)
    tokenfiles.write(spark.createDataFrame(odd, "doc_id long, text string"), P.path("byte_bpe_50k.json"), folder)
    back = tokenfiles.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, -(2**63), 7, 7, 2**63 - 1]
    assert library.decode(np.frombuffer(bytes(back[-1].ids), "<u4").tolist()[:-1]) == "y\0 z"
    folder = shared_dir(spark)
    tokenfiles.write(none, P.path("byte_bpe_50k.json"), folder)
    assert tokenfiles.read(spark, folder).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (3, 0), (200, 5), (1000, 10**6), (500, 700)):
        values = np.sort(rng.integers(0, most + 1, n))
        ef = tokenfiles.EliasFano(*tokenfiles.EliasFano.pack(values), n)
        assert ef.every().tolist() == values.tolist() == [ef.select(i) for i in range(n)]
    wide = np.array([0, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    assert tokenfiles.EliasFano(*tokenfiles.EliasFano.pack(wide), 4).every().tolist() == wide.tolist()


def test_token_counts(docs, none):
    import math

    import regex

    df, rows = docs
    score = {p: -math.log(r + 2.0) for p, r in bpe.load_ranks(RANKS).items()}

    def pieces(t: bytes) -> int:
        best = [(0.0, 0)]
        for d in range(1, len(t) + 1):
            top, n = -math.inf, 0
            for a in range(max(0, d - 40), d):
                s = score.get(t[a:d])
                if s is not None and (best[a][0] + s > top or best[a][0] + s == top and best[a][1] + 1 < n):
                    top, n = best[a][0] + s, best[a][1] + 1
            best.append((top, n))
        return best[-1][1]

    want = {}
    for i, t in rows:
        tokens = regex.findall(P.PATTERN, t or "")
        want[i] = (len((t or "").encode()), len(tokens), sum(pieces(x.encode()) for x in tokens))
    assert got(tokencounts.token_counts(df, RANKS, P.PATTERN), "n_bytes", "n_pretokens", "n_tokens") == want
    assert tokencounts.token_counts(none, RANKS, P.PATTERN).count() == 0


def test_classifier(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    seen = quality.score(documents, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(seen) > 40 and sum(r.predicted == r.quality for r in seen) >= 0.95 * len(seen)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in seen)
    odd = quality.score(docs[0], model).collect()
    assert len(odd) == len(docs[1]) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(docs[0], quality.train(none, labels.limit(0))).collect()} == {0.5}


def test_scores_are_the_gated_sum(spark):
    """The forward pass against plain loops over passages."""
    import math

    rng = np.random.default_rng(3)
    x, counts = quality.features(["word " * 300, "", "A b 1 & " * 200, "é" * 50])
    model = quality.fit(x, counts, np.array([1, 0, 1, 0], np.float32), epochs=3)
    texts = [" ".join(rng.choice(["alpha", "beta", "##", "9", "é"], n)) for n in (1, 90, 700)]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])  # whatever stands beside a text
    w = {k: v.astype(float) for k, v in model.weights.items()}
    for text, score in zip(texts, model.score(texts), strict=True):
        (p, n), encoded, weights = quality.features([text]), [], []
        for row in (p - model.mean) / model.scale:
            h = [math.tanh(sum(row[i] * w["W"][i, j] for i in range(len(row))) + w["b"][j]) for j in range(w["W"].shape[1])]
            gate = [
                math.tanh(sum(h[i] * w["V"][i, k] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["U"][i, k] for i in range(len(h))))) for k in range(len(w["a"]))
            ]
            encoded.append(h)
            weights.append(math.exp(sum(g * a for g, a in zip(gate, w["a"], strict=True))))
        z = [sum(a * h[j] for a, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(w["c"]))]
        assert abs(score - 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])))) < 1e-4 and n[0] == len(encoded)


def test_contradicting_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "# " * (i % 2)) for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 0), (2, 1), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    clean = labels.filter("doc_id not in (1, 2) and quality in (0, 1)")
    texts = ["text", "text # # #"]
    assert quality.train(docs, labels).score(texts).tolist() == quality.train(docs, clean.distinct()).score(texts).tolist()


def test_stages_take_odd_rows(spark, docs, none):
    import corpus_pipeline

    df, rows = docs
    odd = df.unionByName(df.filter("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(None, "some text of no document " * 9, None, None, None, "c", "c", "c")], KIND))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name != "byte-level BPE":
            assert out.columns == df.columns, name
            assert stage(spark, none, SF).count() == 0
        found = [(r.doc_id, getattr(r, "text", None)) for r in out.collect()]
        if name == "n-gram Jaccard join":
            known = [x for x in found if x[0] is not None]
            assert len(known) == len(set(known)) and len(known) < len(found)  # repeated rows are one, rows without doc_id stay
        elif name == "byte-level BPE":
            assert len(found) == odd.count()
        else:
            again = [x for x in found if x[0] is not None and x[0] % 3 == 0]
            assert all(again.count(x) == 2 for x in again), name  # repeated rows share their fate


def test_passages_cover_whole_texts():
    x, counts = quality.features(["", None, "word " * 1000, "x" * 2000, "a\nb"])
    assert counts.tolist()[:2] == [1, 1] and counts[2] >= 12 and counts[3] == 1 and x.shape == (counts.sum(), quality.FEATURES)
    assert np.isfinite(x).all()


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "First\nmessage here"), (1, 1, "bot", "> first\n> Message  HERE\nanswer one"), (1, 2, "user", "> > First\n> answer one\n\nthanks"),
        (1, 3, "user", "new topic"), (1, 4, "bot", "> message here\nlate"), (2, 0, "user", None), (2, 1, "bot", "> message here\nx"), (None, 0, "user", "> q\nz"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string").withColumn("thread", __import__("pyspark").sql.functions.lit(1))
    out = {(r.conv_id, r.turn): (r.text, r.n_quoted, r.reply_to, r.thread, r.position) for r in chat.link(df).collect()}
    assert out == {
        (1, 0): ("First\nmessage here", 0, None, 0, 1), (1, 1): ("answer one", 2, 0, 0, 2), (1, 2): ("thanks", 2, 1, 0, 3),
        (1, 3): ("new topic", 0, None, 3, 1), (1, 4): ("late", 1, 0, 0, 4), (2, 0): ("", 0, None, 0, 1), (2, 1): ("x", 1, None, 1, 1),
        (None, 0): ("z", 1, None, 0, 1),
    }
    assert chat.link(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in rules.keep_good(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = plain.op9(texts.items())
    cut = {i: "\n".join(x) for i, x in plain.left_lines(texts.items()).items()}
    assert {i: plain.hexed(t.encode()) for i, t in cut.items()} == {i: x[1] for i, x in want.items()}
    left = {i: cut[i] for i, (_, c) in plain.op6(cut.items()).items() if c == i}
    clean = {i for i, x in plain.op2(left.items(), bench).items() if not x[4]}
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == {i: plain.hexed(left[i].encode()) for i in clean}
    assert 0 < len(out) < len(docs) and [n for n, _ in corpus_pipeline.STAGES] and F is not None


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline", *(f"op{i}" for i in range(1, 11))} <= {n.split("_")[0] for n in names} | {"pipeline"}
    assert set(e.oracle_sql()) <= names and json and hashlib
