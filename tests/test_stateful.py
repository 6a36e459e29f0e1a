"""Stateful streams over several batches and restarts tell what one pass over all times tells."""

import random
from datetime import datetime, timezone

import pytest

from boardlake.streaming import stateful

HOUR, SECOND = 3_600_000_000, 1_000_000
KIND = "source string, posting_id long, ts timestamp"


def _landed(seed):
    """Times in microseconds of three keys, in five files of growing time; the third key goes silent early."""
    rng, files, now = random.Random(seed), [], 1_700_000_000 * SECOND
    for f in range(5):
        rows = []
        for _ in range(12):
            now += rng.choice([60 * SECOND, HOUR, 3 * HOUR, 9 * HOUR, 30 * HOUR])
            rows += [(k, now + k * SECOND) for k in (1, 2, 3) if k < 3 or f < 2 and rng.random() < 0.5]
        files.append(rng.sample(rows, len(rows)))
    return files


def _lives(rows, window, keep, mark):
    out = []
    for key in {k for k, _ in rows}:
        last = delisted = None
        for t in [*sorted(t for k, t in rows if k == key), None]:
            now = mark if t is None else t
            if last is not None and delisted is None and now >= last + window:
                delisted = last + window
                out.append((key, "delisted", delisted))
            if delisted is not None and now >= delisted + keep:
                out.append((key, "deleted", delisted + keep))
                last = delisted = None
            if t is not None:
                out += [(key, "listed" if last is None else "revived", t)] if last is None or delisted is not None else []
                last, delisted = t, None
    return sorted((k, e, t // SECOND) for k, e, t in out)


def _alerts(rows, stall, episode, mark):
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        for t, after in zip(times, [*times[1:], None], strict=True):
            due = [t + stall + i * episode for i in range(1000) if t + stall + i * episode <= (mark if after is None else after)]
            out += [(str(key), t // SECOND, i, d // SECOND) for i, d in enumerate(due, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["lifecycle", "liveness"])
def test_batches_and_restarts(spark, tmp_path, kind):
    files, place = _landed(9), str(tmp_path / "landed")
    window, keep = 12 * HOUR, 48 * HOUR

    def stream():
        seen = stateful.landed(spark, place, KIND, per_batch=1)
        return stateful.lifecycle(seen, window // SECOND, keep // SECOND) if kind == "lifecycle" else stateful.liveness(seen)

    for some in (files[:1], files[1:3], files[3:]):  # each run starts anew from the state that the one before it left
        for rows in some:
            at = [(str(k), k, datetime.fromtimestamp(t / SECOND, timezone.utc)) for k, t in rows]
            spark.createDataFrame(at, KIND).coalesce(1).write.mode("append").parquet(place)
        told = stateful.run(stream(), str(tmp_path / "run"))
    every = [r for f in files for r in f]
    mark = max(t for _, t in every) - HOUR
    want = _lives(every, window, keep, mark) if kind == "lifecycle" else _alerts(every, 2 * HOUR, 6 * HOUR, mark)
    assert len(want) > 30
    assert sorted(tuple(r) for r in told.collect()) == want
