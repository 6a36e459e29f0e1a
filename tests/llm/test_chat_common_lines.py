"""Answers where many messages write and quote the same lines, against all pairs in plain Python."""

import random
import time
from collections import defaultdict

import pytest

from boardlake.llm import chat

KIND = "conv_id long, turn long, role string, text string"


def _messages(seed, convs=6, turns=40, lines=9):
    rng = random.Random(seed)
    words = [f"Line {i}" for i in range(lines)]
    rows = []
    for c in range(convs):
        for t in range(turns):
            own = [w for i, w in enumerate(words) if rng.random() < 0.5 / (i + 1)] + [f"own {c} {t}"] * (rng.random() < 0.5)
            quoted = [w for i, w in enumerate(words) if rng.random() < 0.4 / (i + 1)] + [f"own {c} {rng.randrange(turns)}"] * (rng.random() < 0.4)
            rows.append((c, t * 2, "user", "\n".join([*(f"> {q}" for q in quoted), *own])))
    return rows


def _answers(rows):
    own, out = defaultdict(dict), {}
    for c, t, _, text in rows:
        own[c][t] = {x.lower() for x in text.split("\n") if x.strip() and not x.startswith(">")}
    for c, t, _, text in rows:
        quoted = {x[2:].lower() for x in text.split("\n") if x.startswith("> ")}
        out[c, t] = max(((len(quoted & o), f) for f, o in own[c].items() if f < t and quoted & o), default=(0, None))[1]
    return out


@pytest.mark.parametrize("rare", [0, 3, 10, 1000])
def test_common_lines(spark, rare, monkeypatch):
    monkeypatch.setattr(chat, "RARE", rare)
    rows = _messages(rare)
    lines = chat._lines(spark.createDataFrame(rows, KIND).selectExpr("conv_id AS _conv", "turn AS _turn", "text AS _text"))
    found = {(r._conv, r._turn): r._to for r in chat._answered(lines).collect()}
    assert found == {k: v for k, v in _answers(rows).items() if v is not None}


def test_one_line_that_ten_thousand_messages_write_and_quote(spark):
    n = 10_000
    df = spark.range(n).selectExpr("1L AS _conv", "id AS _turn", "concat('> ok\nok\nturn ', id) AS _text")
    began = time.time()
    found = {r._turn: r._to for r in chat._answered(chat._lines(df)).collect()}
    assert found == {t: t - 1 for t in range(1, n)}
    assert time.time() - began < 60
