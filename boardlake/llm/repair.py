"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's roles should read (s?(ua)+)?: nothing, or an optional system turn and pairs of user and assistant. A lattice
node is a number of rows read and what the repaired part ends in; edges keep, rename or delete a row or insert an empty one.
A forward and a reverse heap of nodes grow in turn, cheaper side first. Every edge from a node settled forward to one settled
in reverse is a crossing; both go on until no crossing of equal cost can be left, and of the cheapest the one of least audit
(the least way to the node, the edit, the least way on) is taken. No audit of a node is the start of another of equal cost, as
only inserts read no row and they cost, so least parts make the least whole.

Rows are dealt by ranges of conversation and turn. A conversation that one task holds in one piece is repaired there. One
that is split over tasks or long is cut into pieces; each piece gives its cheapest way for each state before and after, and
the pieces' ways are then put together in order. So a conversation of any length is searched in many tasks, in bounded
memory; only its digest, which is one hash over all its rows, is taken in one task, row by row as they pass.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import materialise, small_enough

DELETE, RENAME, INSERT, CUT_OFF = 4, 3, 3, 3
#: Rows and code points of a piece, at most (of code points one row more).
ROWS, CHARS = 1000, 4 << 20
BLANK = r"[^\x20\x09-\x0D]"
_SPACE = " \t\n\v\f\r"
#: States: nothing yet, system, user, assistant; what may follow each, by role initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the user or assistant turn that must follow, and the states that such a turn may follow.
AFTER = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
WHOLE = (0, 3)
_LEGAL = {"su", "ua", "au"}
_FAR = float("inf")
Way = tuple[float, str]


def cheapest(rows: list[tuple[str, bool, bool]], start: int, goals: tuple[int, ...]) -> Way:
    """Cost and least audit of the cheapest edits of rows (role initial, must go, cut off) from a state to one of others."""
    n = len(rows)
    ways: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, q): (0, "") for q in goals})
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, -n, q) for q in goals])
    heapq.heapify(heaps[1])
    settled: tuple[set, set] = (set(), set())
    best: Way = (_FAR, "")

    def ahead(i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
        yield INSERT, "I", i, AFTER[q]
        if i < n:
            initial, must, cut = rows[i]
            yield DELETE, "D", i + 1, q
            if not must:
                if initial in NEXT[q]:
                    yield CUT_OFF * cut, "K", i + 1, NEXT[q][initial]
                yield RENAME + CUT_OFF * cut, "R", i + 1, AFTER[q]

    def back(i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
        for p in BEFORE[q]:
            yield INSERT, "I", i, p
        if i:
            initial, must, cut = rows[i - 1]
            yield DELETE, "D", i - 1, q
            if not must:
                for p in range(4):
                    if NEXT[p].get(initial) == q:
                        yield CUT_OFF * cut, "K", i - 1, p
                for p in BEFORE[q]:
                    yield RENAME + CUT_OFF * cut, "R", i - 1, p

    while heaps[0] or heaps[1]:
        low = [h[0][0] if h else _FAR for h in heaps]
        if best[0] < low[0] + low[1]:
            break
        side = 0 if heaps[0] and low[0] <= low[1] else 1
        cost, i, q = heapq.heappop(heaps[side])
        at = (abs(i), q)
        if at in settled[side] or ways[side][at][0] < cost:
            continue
        settled[side].add(at)
        audit = ways[side][at][1]
        if at in settled[1 - side]:
            other = ways[1 - side][at]
            best = min(best, (cost + other[0], audit + other[1] if side == 0 else other[1] + audit))
        for price, edit, j, p in (back if side else ahead)(*at):
            to = (j, p)
            way = (cost + price, audit + edit if side == 0 else edit + audit)
            if to in settled[1 - side]:
                other = ways[1 - side][to]
                best = min(best, (way[0] + other[0], way[1] + other[1] if side == 0 else other[1] + way[1]))
            if to not in settled[side] and (to not in ways[side] or way < ways[side][to]):
                if to not in ways[side] or way[0] < ways[side][to][0]:
                    heapq.heappush(heaps[side], (way[0], -j if side else j, p))
                ways[side][to] = way
    return best


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that the edits leave, in order."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            state = AFTER[state]
            role = "user" if state == 2 else "assistant"
        yield edit, role, text


class _Piece:
    """Rows of one conversation that follow each other, and what is counted of them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.texts: list[tuple[str, str]] = []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.initial = self.final = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        seen = text.rstrip(_SPACE)
        fault = "blank" if not seen else "duplicate" if again else "truncated" if seen[-1] not in ".!?" else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if not self.rows:
            self.initial, self.first = role[:1], turn
        else:
            self.illegal += self.final + role[:1] not in _LEGAL
        if turn is not None and (self.high is None or turn != self.high):
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.final, self.last = role[:1], turn
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.texts.append((role, text))
        self.chars += len(text)

    def counts(self) -> dict:
        return {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "initial", "final")}


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, initial string, final string"
_PIECES = f"_conv bigint, _part bigint, _piece bigint, whole boolean, ways array<struct<before:int,after:int,cost:bigint,audit:string>>, sha string, {_COUNTS}"
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
_WAYS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SCHEMA = pa.schema(
    [("_conv", pa.int64()), ("_part", pa.int64()), ("_piece", pa.int64()), ("whole", pa.bool_()), ("ways", _WAYS), ("sha", pa.string())]
    + [(x.split()[0], _KINDS[x.split()[1]]) for x in _COUNTS.split(", ")]
)


def _digest(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    state, between = hashlib.sha256(), b""
    for _, role, text in repaired(audit, rows):
        state.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return state.hexdigest()


def _told(conv: int | None, number: int, piece: _Piece, whole: bool) -> dict:
    out = {"_conv": conv, "_part": TaskContext.get().partitionId(), "_piece": number, "whole": whole, "sha": None, **piece.counts()}
    if whole:
        cost, audit = cheapest(piece.rows, 0, WHOLE)
        return out | {"ways": [{"before": 0, "after": 0, "cost": cost, "audit": audit}], "sha": _digest(audit, iter(piece.texts))}
    ways = [(p, q, cheapest(piece.rows, p, (q,))) for p in range(4) for q in range(4) if (q == p or q > 1 or p == 0)]
    return out | {"ways": [{"before": p, "after": q, "cost": c, "audit": a} for p, q, (c, a) in ways if c < _FAR]}


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_conv, turn, role, text, _again, _copies) in; the pieces of their conversations out, of so many rows at most."""
    conv, piece, number, first, before = None, None, 0, True, None
    for batch in batches:
        out = []
        for c, turn, role, text, again, copies in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if piece is not None and c != conv:
                out.append(_told(conv, number, piece, not first and number == 0))
                piece, number, first, before = None, 0, False, None
            conv = c
            for _ in range(copies):
                if piece is not None and (len(piece.rows) >= most or piece.chars >= CHARS):
                    out.append(_told(conv, number, piece, False))
                    piece, number = None, number + 1
                piece = piece or _Piece()
                piece.add(turn, role, text, again or before == (turn, role, text))
                before = (turn, role, text)
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
    if piece is not None:
        yield pa.RecordBatch.from_pylist([_told(conv, number, piece, False)], _SCHEMA)


class _Joined:
    """The pieces of one conversation, put together in order: for each state the least way so far, as a chain of parts."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        self.piece: dict | None = None

    @staticmethod
    def _less(x: tuple | None, y: tuple | None) -> bool:
        """Whether the chain x (before, audit) reads less than y; both have equally many parts and are walked back to where they meet."""
        parts: list[tuple[str, str]] = []
        while x is not y:
            parts.append((x[1], y[1]))
            x, y = x[0], y[0]
        mine, theirs = ("".join(p[k] for p in reversed(parts)) for k in (0, 1))
        return mine < theirs

    def add(self, piece: dict) -> None:
        made: dict[int, tuple[int, tuple | None]] = {}
        for way in piece["ways"]:
            if way["before"] in self.ways:
                cost, chain = self.ways[way["before"]]
                new = (cost + way["cost"], (chain, way["audit"]))
                old = made.get(way["after"])
                if old is None or new[0] < old[0] or new[0] == old[0] and self._less(new[1], old[1]):
                    made[way["after"]] = new
        self.ways = made
        if self.piece is None:
            self.piece = {k: v for k, v in piece.items() if k not in ("ways", "sha")}
            return
        so_far = self.piece
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            so_far[k] += piece[k]
        so_far["illegal"] += so_far["final"] + piece["initial"] not in _LEGAL
        if piece["low"] is not None:
            so_far["turns"] -= so_far["high"] == piece["low"]
            so_far["low"] = piece["low"] if so_far["low"] is None else so_far["low"]
            so_far["high"] = piece["high"]
        so_far["final"] = piece["final"]

    def end(self) -> Way:
        found = [self.ways[q] for q in WHOLE if q in self.ways]
        least = found[0]
        for way in found[1:]:
            if way[0] < least[0] or way[0] == least[0] and self._less(way[1], least[1]):
                least = way
        parts, chain = [], least[1]
        while chain is not None:
            parts.append(chain[1])
            chain = chain[0]
        return least[0], "".join(reversed(parts))


def _copied(copies: int, role: str, text: str) -> Iterator[tuple[str, str]]:
    for _ in range(copies):
        yield role, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _replayed(each: Callable[[int | None, _Joined, Way, Iterator[tuple[str, str]]], Iterator[dict]]) -> Callable:
    """A function over rows sorted so that a conversation's pieces come before its rows: each() is given both in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = _stream(batches)
        row = next(rows, None)
        while row is not None:
            conv, joined = row["_conv"], _Joined()
            while row is not None and row["_conv"] == conv and row["_kind"] == 0:
                joined.add(row["_of"])
                row = next(rows, None)

            def texts() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row["_conv"] == conv and row["_kind"] == 1:  # noqa: B023
                    yield from _copied(row["_copies"], row["role"], row["text"])
                    row = next(rows, None)

            left = texts()
            yield from each(conv, joined, joined.end(), left)
            for _ in left:  # rows after the last that was kept
                pass

    return run


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row.get("text") or "")
        if len(out) >= 1000 or size > CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _digests(conv: int | None, joined: _Joined, way: Way, texts: Iterator[tuple[str, str]]) -> Iterator[dict]:
    yield joined.piece | {"_conv": conv, "whole": True, "ways": [{"before": 0, "after": 0, "cost": way[0], "audit": way[1]}], "sha": _digest(way[1], texts)}


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _turns(conv: int | None, joined: _Joined, way: Way, texts: Iterator[tuple[str, str]]) -> Iterator[dict]:
    for i, (edit, role, text) in enumerate(repaired(way[1], texts), 1):
        yield {"conv_id": conv, "position": i, "edit": edit, "role": role, "text": text}


def _rows(conversations: DataFrame) -> DataFrame:
    """_conv, turn, role, text, _again (an earlier turn says the same), _copies. Null roles and texts are one space."""
    copies = F.col("_copies") if "_copies" in conversations.columns else F.lit(1)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("_copies"),
    ).withColumn("_said", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)))
    when = F.struct(F.col("turn").isNotNull().alias("_known"), "turn")
    said = rows.groupBy(F.col("_conv").alias("_c"), F.col("_said").alias("_s")).agg(F.min(when).alias("_first"), F.max(when).alias("_latest"))
    twice = small_enough(materialise(said.filter("_first != _latest").drop("_latest")))
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_said") == F.col("_s"))
    again = F.coalesce(when > F.col("_first"), F.lit(False)).alias("_again")
    return materialise(rows.join(twice, same, "left").select("_conv", "turn", "role", "text", again, "_copies"))


def _replay(rows: DataFrame, pieces: DataFrame, each: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """each() for every conversation of the pieces, with its rows."""
    order = ["_conv", "_kind", "_part", "_piece", "turn", "role", "text"]
    zero, none = F.lit(None).cast("long"), F.lit(None).cast("string")
    of = F.struct(*[c for c in pieces.columns if c not in ("_conv", "_part")])
    heads = pieces.select("_conv", F.lit(0).alias("_kind"), "_part", "_piece", zero.alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).alias("_copies"), of.alias("_of"))
    nothing = F.lit(None).cast(heads.schema["_of"].dataType).alias("_of")
    tails = rows.select("_conv", F.lit(1).alias("_kind"), zero.alias("_part"), zero.alias("_piece"), "turn", "role", "text", "_copies", nothing)
    by = [F.col(c).asc_nulls_first() for c in order]
    both = heads.unionByName(tails).repartition("_conv").sortWithinPartitions(*by)
    run = _replayed(each)
    return both.mapInArrow(lambda batches: _batched(run(batches), schema), ddl)


def _searched(rows: DataFrame, most: int) -> DataFrame:
    by = [F.col("_conv"), F.col("turn"), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(*[c.asc_nulls_first() for c in (*by[:3], F.substring("text", 1, 32))])
    return materialise(dealt.sortWithinPartitions(*[c.asc_nulls_first() for c in by]).mapInArrow(lambda batches: _pieces(batches, most), _PIECES))


def repair(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """Per conversation (conv_id), searched in pieces of so many rows at most: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text; other columns are left out) are taken by turn, nulls first; rows of one turn by role, then
    text. Null roles and texts are one space, so a null text is blank. A null conv_id is one conversation. Equal rows are
    duplicates. Of a conversation without rows nothing is said; an empty table gives none.
    """
    rows = _rows(conversations)
    pieces = _searched(rows, most)
    split = materialise(pieces.filter("not whole"))
    named = small_enough(materialise(split.select(F.col("_conv").alias("_c")).distinct()))
    some = rows.join(named, F.col("_conv").eqNullSafe(F.col("_c")), "left_semi")
    found = pieces.filter("whole").unionByName(_replay(some, split, _digests, _SCHEMA, _PIECES))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    way = F.col("ways")[0]
    return found.select(
        F.col("_conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", way["cost"].alias("cost"),
        way["audit"].alias("audit"), F.col("sha").alias("repaired_sha256"),
    )


def repaired_turns(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text of the repaired conversations; rows are taken as in repair()."""
    rows = _rows(conversations)
    return _replay(rows, _searched(rows, most), _turns, _TURNS, "conv_id bigint, position bigint, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _copies of rows damaged by crc32 of `conv_id:turn`, of 20: 0 goes, 1 loses its text, 2 its
    ends of sentences, 3 stands twice, 4 becomes the user's. Nulls are one space there and in roles and texts."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("_m")
    ).filter("_m != 0")
    text = F.when(F.col("_m") == 1, "").when(F.col("_m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_m") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_m") == 3, 2).otherwise(1).alias("_copies"))


def report(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """repair() of the damaged rows for every conversation of the table; zeros, empty audit and the hash of nothing where none is left."""
    found = repair(damaged(conversations), most)
    every = conversations.select(F.col("conv_id").cast("long").alias("_every")).distinct()
    out = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("_every").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
