"""N-gram Jaccard join with PartEnum signatures, and its groups.

Method. A document is the set of its 5-word shingles. Sets fall into size bands whose ends
grow by 1 / 0.75; two sets of Jaccard 0.75 or more lie in one band or in neighbouring ones,
and each set takes part in its own band and the next. In a band of largest size r such sets
differ in at most k = (1 - 0.75) / (1 + 0.75) * 2r shingles. The shingle domain is partitioned
on two levels: into groups, and each group into PARTS = 3 parts. If the sets differ in at most
one shingle of a group, two of its three parts are equal. So each set enumerates for each
group the subsets of PARTS - 1 parts, and a subset with the shingles in it is a signature; sets
that differ in d shingles share a signature in all groups but d // 2 of them. A band has some
groups more than k // 2 + 1, so that similar sets share several signatures and some may be
left out: signatures are put in one order for all sets, those of no shingle at all first, then
from frequent to rare, and each set leaves out as many from the front as it can spare. The
last of the common ones in that order can't be left out by either set. That keeps passages
that many documents share out of the signatures without losing a pair.

Equal sets are one class from the start. In a signature's group nobody is paired with
everybody: each class is held against the group's pivot, verified links merge classes into
components, and after each round only members of other components are still open. The last
round compares what is still open between components, block by block, so no link is missed.

Candidates whose bucket counts differ too much are dropped, which loses none; the others are
verified on the words themselves. Only minima, counts and verified links are
shuffled; ids, links and components never come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.chunks import groups
from boardlake.llm.common import drop, fresh, materialise, small_enough

SHINGLE = 5
#: Least similarity as a fraction.
ALIKE, OF = 75, 100
#: Rounds in which open members meet one pivot of their group before the last round.
ROUNDS = 1
#: Sets of a block, about, where what is still open is compared.
BLOCK = 256
#: The same where links are counted.
LINK_BLOCK = 128
#: Parts of a group; a signature is a subset of all but one of them.
PARTS = 3
#: Groups beyond those in which similar sets may differ twice, as a share of them, and at least.
SPARE, LEAST_SPARE = 0.05, 1
#: A row's tag is how many signatures its set may still leave out and, in so many low bits, its band.
BAND_BITS = 8
#: Bits of a signature that are shuffled; two that fall together cost a comparison, no more.
SIGNATURE_BITS = 48
#: Of these so many bytes besides the slot's bits.
_LOW_BYTES = 5
#: Bits of a slot where there are few signatures, and signatures of a slot, about, beyond which slots become more.
MOST_FEW, SLOT_SIGNATURES = 6, 30_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_PLACES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte in lower case (A-Z alone), whether it is white space, and a random number for each place and byte."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return low, space, _mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _ODD[0])


_LOW, _SPACE, _NUMBER = _byte_tables()


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; of the whole sequence if it is shorter.

    All texts are hashed at once: a word's hash is the sum of numbers for its bytes and their places.
    """
    raws = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
    ends_ = np.cumsum([len(r) + 1 for r in raws])  # place of the space after each text
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(start):
        return [np.empty(0, np.uint64) for _ in texts]
    size = stop - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = _LOW[data[~space]].astype(np.int64)
    value = _NUMBER[place % _PLACES * 256 + letters] * (2 * (place // _PLACES) + 1).astype(np.uint64)
    h = _mix(np.add.reduceat(value, first))
    bounds = np.searchsorted(start, ends_)
    rolled = np.full(len(h), SHINGLE, np.uint64)
    for i in range(SHINGLE):
        part = _mix(h[i:] * _ODD[i])
        rolled[: len(part)] += part
    rolled = _mix(rolled)
    out, at = [], 0
    for end in bounds:
        n = end - at
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : end - SHINGLE + 1]))
        elif n:
            short = np.uint64(n)
            for i in range(n):
                short = short + _mix(h[at + i : at + i + 1] * _ODD[i])
            out.append(_mix(short))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def ends() -> list[int]:
    """Largest size of each band; the last is beyond any set."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * OF // ALIKE))
    return out


_ENDS = np.array(ends())


def differ(a: int, b: int) -> int:
    """In how many shingles similar sets of these sizes differ at most."""
    return (a + b) * (OF - ALIKE) // (OF + ALIKE)


def _group_counts() -> np.ndarray:
    """Number of groups in each band."""
    half = (2 * np.array(ends(), dtype=np.int64) * (OF - ALIKE) // (OF + ALIKE)) // 2
    return half + 1 + np.maximum(LEAST_SPARE, np.ceil(SPARE * half).astype(np.int64))


_GROUPS = _group_counts()


def signatures(sets: list[np.ndarray], above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets in their own band (above 0) or the next (1), the number of the set of each, and its tag.

    Of the band's groups g, similar sets have a signature in common in all but d // 2, if they differ in d shingles; so a set
    may leave out g - 1 - d // 2 with the largest d it may have. Signatures without a shingle are left out here, by their
    place; the tag has how many more may go. Sets that only equal ones are similar to have no signatures.
    """
    size = np.array([len(h) for h in sets], np.int64)
    band = np.searchsorted(_ENDS, size) + above
    most = (size + np.minimum(_ENDS[band], size * OF // ALIKE)) * (OF - ALIKE) // (OF + ALIKE)
    use = np.flatnonzero((size > 0) & (most > 0))
    if not len(use):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    size, band, most, g = size[use], band[use], most[use], _GROUPS[band[use]]
    hashes, of = np.concatenate([sets[i] for i in use]), np.repeat(np.arange(len(use)), size)
    first = np.cumsum(g) - g
    part = (_mix(hashes ^ (np.uint64(0x5851F42D4C957F2D) + band.astype(np.uint64))[of]) % (PARTS * g).astype(np.uint64)[of]).astype(np.int64)
    part += PARTS * first[of]
    sums = np.zeros(PARTS * int(g.sum()), np.uint64)
    np.add.at(sums, part, _mix(hashes + np.uint64(0x2545F4914F6CDD1D)))
    sums, count = sums.reshape(-1, PARTS), np.bincount(part, minlength=len(sums)).reshape(-1, PARTS)
    owner = np.repeat(np.arange(len(use)), g)
    place = np.arange(len(owner)) - first[owner]
    # of each group the subsets that lack one part: in each column what the other parts hold
    held = count.sum(1, keepdims=True) - count
    value = (sums * _ODD[:PARTS]).sum(1, keepdims=True, dtype=np.uint64) - sums * _ODD[:PARTS]
    salt = _mix((band[owner, None].astype(np.uint64) << np.uint64(40)) + (place[:, None] * PARTS + np.arange(PARTS)).astype(np.uint64))
    made = (_mix(value ^ salt) >> np.uint64(64 - SIGNATURE_BITS)).view(np.int64)
    leave, empty = g - 1 - most // 2, held == 0
    n_empty = np.bincount(owner, weights=empty.sum(1), minlength=len(use)).astype(np.int64)
    kept = ~empty
    for i in np.flatnonzero(n_empty > leave):  # more than may go: the rest by their place
        rows = slice(first[i], first[i] + g[i])
        flat = np.flatnonzero(empty[rows].ravel())[leave[i] :]
        kept[rows].ravel()[flat] = True  # a view
    tag = (np.maximum(0, leave - n_empty) << BAND_BITS) + band
    each = np.broadcast_to(owner[:, None], kept.shape)[kept]
    return made[kept], use[each], tag[each]


def sketch(hashes: np.ndarray) -> bytes:
    """Shingles in each of a power of two of buckets, at most one shingle a bucket on average."""
    n = 1 << max(6, len(hashes).bit_length())
    counts = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes], n: int) -> np.ndarray:
    """The sketches, one a row, with n buckets each."""
    return np.stack([np.frombuffer(x, np.uint8).reshape(-1, n).sum(0, dtype=np.int16) for x in sketches])


def may_match(x: bytes, y: bytes, a: int, b: int) -> bool:
    """False only if the sketches alone show that sets of sizes a and b differ too much."""
    u, v = folded([x, y], min(len(x), len(y)))
    return int(np.abs(u - v).sum()) <= differ(a, b)


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for a, b in groups([t or "" for t in texts], 300_000):
        yield from shingles(texts[a:b])


def _fingerprints(df: DataFrame) -> DataFrame:
    """_doc, n_shingles, _a, _b (two fingerprints of the set)."""
    names = ["_doc", "n_shingles", "_a", "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(h), *_prints(h)) for h in _sets(batch.column(1).to_pylist())]
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return df.select(F.col("doc_id").cast("long").alias("_doc"), "text").mapInArrow(run, "_doc bigint, n_shingles bigint, _a bigint, _b bigint")


def _prints(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        x = np.array([h.sum(dtype=np.uint64), _mix(h ^ np.uint64(0x1D8E4E27C47D124F)).sum(dtype=np.uint64)])
    return tuple(_mix(x + np.uint64(len(h))).view(np.int64).tolist())


#: Of a set in a slot: its fingerprint, and of its own band and the next one how many signatures follow and their tag.
_HEAD = np.dtype([("a", "<i8"), ("n", "<u4", 2), ("tag", "<u4", 2)])


def _planes(x: np.ndarray, width: int) -> bytes:
    """The first bytes of each number, then the second ones and so on: bytes that are alike lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def _slot_bits(shingles_: int) -> int:
    """Bits of a signature that say its slot, for so many shingles, of which each makes about one signature."""
    return max(min(MOST_FEW, (shingles_ // 1_000_000).bit_length()), (shingles_ // SLOT_SIGNATURES).bit_length())


def _packed(df: DataFrame, bits: int) -> DataFrame:
    """_slot, _heads, _sigs: signatures by their first bits, many sets a row; a task signs a set once, however many copies it meets.

    A row of its own for each signature took twice the room when shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in groups([t or "" for t in texts], 500_000):
                new = []
                for h in _sets(texts[start:end]):
                    a = _prints(h)[0]
                    if len(h) and a not in done:
                        new.append((a, h))
                        if len(done) < 200_000:
                            done.add(a)
                made = [signatures([h for _, h in new], above) for above in (0, 1)]
                sig, of = (np.concatenate([m[i] for m in made]) for i in (0, 1))
                if not len(sig):
                    continue
                above, tags = np.repeat([0, 1], [len(m[0]) for m in made]), np.zeros((len(new), 2), np.uint32)
                for i, m in enumerate(made):
                    tags[m[1], i] = m[2]
                slot, low = _slot_of(sig, bits)
                order = np.lexsort((above, of, slot))
                slot, low, of, above = slot[order], low[order], of[order], above[order]
                runs = np.flatnonzero(np.concatenate([[True], (np.diff(slot) != 0) | (np.diff(of) != 0)]))
                heads = np.zeros(len(runs), _HEAD)
                heads["a"], heads["tag"] = np.array([a for a, _ in new], np.int64)[of[runs]], tags[of[runs]]
                heads["n"][:, 1] = np.add.reduceat(above, runs)
                heads["n"][:, 0] = np.diff(np.append(runs, len(of))) - heads["n"][:, 1]
                slots, first = np.unique(slot, return_index=True)
                last, at = np.append(first[1:], len(slot)), np.searchsorted(runs, np.append(first, len(slot)))
                rows = [(int(s), _planes(heads[at[i] : at[i + 1]], _HEAD.itemsize), _planes(low[first[i] : last[i]], _LOW_BYTES)) for i, s in enumerate(slots)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["_slot", "_heads", "_sigs"])

    return df.select("text").mapInArrow(run, "_slot int, _heads binary, _sigs binary")


def _slot_of(sig: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each signature, and what is left of it, in _LOW_BYTES at most; bits past those are left out."""
    left = min(SIGNATURE_BITS, 8 * _LOW_BYTES + bits) - bits
    sig = sig >> (SIGNATURE_BITS - left - bits)
    return sig >> left, sig & ((1 << left) - 1)


def _shared(packed: DataFrame, bits: int) -> DataFrame:
    """_sig, _a, _tag, _n (rows of the signature) of signatures that two sets have at least; a slot is a task, and
    held there as it came, but for a range of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, low, slot = [], [], 0
        for batch in batches:
            for s, head, sigs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = s
                heads.append(np.ascontiguousarray(np.frombuffer(head, np.uint8).reshape(_HEAD.itemsize, -1).T).view(_HEAD).ravel())
                low.append(np.frombuffer(sigs, np.uint8).reshape(_LOW_BYTES, -1))
        if not heads:
            return
        heads, low = np.concatenate(heads), np.concatenate(low, axis=1)
        owner, tag = np.repeat(np.arange(2 * len(heads), dtype=np.int32), heads["n"].ravel()), heads["tag"].ravel()
        top = low[-1]
        step = max(1, 256 * 1_000_000 // len(owner))
        for begin in range(0, 256, step):
            at = np.flatnonzero((top >= begin) & (top < begin + step))
            if not len(at):
                continue
            sig = np.zeros(len(at), np.int64)
            for i in range(_LOW_BYTES):
                sig |= low[i, at].astype(np.int64) << (8 * i)
            order = np.argsort(sig, kind="stable")
            sig, of = sig[order], owner[at][order]
            who = heads["a"][of // 2]
            first = np.flatnonzero(np.concatenate([[True], np.diff(sig) != 0]))
            many = np.diff(np.append(first, len(sig)))
            kept = np.repeat(np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first), many)
            named = sig[kept] + (slot << (min(SIGNATURE_BITS, 8 * _LOW_BYTES + bits) - bits))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (named, who[kept], tag[of[kept]], np.repeat(many, many)[kept])], names=["_sig", "_a", "_tag", "_n"])

    return packed.repartitionById(1 << bits, "_slot").mapInArrow(run, "_sig bigint, _a bigint, _tag bigint, _n bigint")


def _signed(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """_sig, _a: signatures of sets that share one with another set, after each set has left out
    its most frequent ones. Signatures that one set alone has are its rarest and need no row."""
    bits = _slot_bits(prints.agg(F.sum("n_shingles")).first()[0] or 0)
    once = _shared(_packed(documents, bits), bits).groupBy("_a", "_tag", "_sig").agg(F.first("_n").alias("_n"))  # two tasks may have signed one set
    rank = F.row_number().over(Window.partitionBy("_a", "_tag").orderBy(F.desc("_n"), F.desc("_sig")))  # the signatures of one set
    kept = once.withColumn("_rank", rank).filter(F.col("_rank") > F.shiftright("_tag", BAND_BITS))
    return materialise(kept.select("_sig", "_a"))


def components(edges: DataFrame) -> DataFrame:
    """_node, _comp (least node that can be reached) of every node of the links _x, _y.

    Each round every node gives way to the one of least hash among itself and its neighbours, and
    links are carried over to those, until none is left; hashes make the rounds few for chains too.
    Then the rounds' names are followed and the least node of each name is told. Only minima are
    gathered, and a node of very many links is added up before the shuffle.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("_x"), F.least(x, y).alias("_y"))
    edges = materialise(edges.filter("_x != _y").select(*pair("_x", "_y")).distinct())
    rounds = []
    while not rounds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("_y").alias("_x"), F.col("_x").alias("_y")))
        least = F.least(F.struct(F.xxhash64("_x").alias("h"), F.col("_x").alias("n")), F.min(F.struct(F.xxhash64("_y").alias("h"), F.col("_y").alias("n"))))
        up = materialise(both.groupBy("_x").agg(least["n"].alias("_up")).withColumnRenamed("_x", "_from"))
        rounds.append(up)
        to = lambda name, new: small_enough(up.withColumnRenamed("_from", f"_f{name}").withColumnRenamed("_up", new))  # noqa: B023, E731
        moved = edges.join(to("x", "_a"), F.col("_x") == F.col("_fx")).join(to("y", "_b"), F.col("_y") == F.col("_fy"))
        before, edges = edges, materialise(moved.filter("_a != _b").select(*pair("_a", "_b")).distinct())
        drop(before)
    names = rounds[0].select(F.col("_from").alias("_node"), F.col("_up").alias("_name"))
    for up in rounds[1:]:
        names = names.join(small_enough(up), F.col("_name") == F.col("_from"), "left").select("_node", F.coalesce("_up", "_name").alias("_name"))
    names = materialise(names)
    drop(edges, *rounds)
    least = materialise(names.groupBy("_name").agg(F.min("_node").alias("_comp")).withColumnRenamed("_name", "_of"))
    out = materialise(names.join(small_enough(least), F.col("_name") == F.col("_of")).select("_node", "_comp"))
    drop(names, least)
    return out


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs without those whose sketches differ too much."""
    one = lambda to: sketches.select(F.col("_node").alias(f"_{to}"), F.col("_size").alias(f"_s{to}"), F.col("_sketch").alias(f"_k{to}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, *sides = (batch.column(c) for c in ("_x", "_y", "_kx", "_ky", "_sx", "_sy"))
            may = [may_match(*r) for r in zip(*(c.to_pylist() for c in sides), strict=True)]
            yield pa.RecordBatch.from_arrays([x, y], names=["_x", "_y"]).filter(pa.array(may, pa.bool_()))

    return pairs.join(one("x"), "_x").join(one("y"), "_y").select("_x", "_y", "_kx", "_ky", "_sx", "_sy").mapInArrow(run, "_x bigint, _y bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs _x, _y whose texts are similar."""
    t = texts.select(F.col("_id").alias("_x"), F.col("text").alias("_tx"))
    u = texts.select(F.col("_id").alias("_y"), F.col("text").alias("_ty"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, tx, ty = (batch.column(c) for c in ("_x", "_y", "_tx", "_ty"))
            same = [similar(a.as_py(), b.as_py()) for a, b in zip(tx, ty, strict=True)]
            yield pa.RecordBatch.from_arrays([x, y], names=["_x", "_y"]).filter(pa.array(same, pa.bool_()))

    return pairs.select("_x", "_y").join(t, "_x").join(u, "_y").select("_x", "_y", "_tx", "_ty").mapInArrow(run, "_x bigint, _y bigint")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """_id, text, _size, _sketch of the documents that wanted (_id) names, one row each."""
    some = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").join(small_enough(wanted), "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(h), sketch(h)) for h in _sets(batch.column(1).to_pylist())]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["_id", "text", "_size", "_sketch"])

    return some.mapInArrow(run, "_id bigint, text string, _size bigint, _sketch binary")


def linked(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets and groups: (_doc, n_shingles, _a, _b of every row; _a, _b, n_shingles, _comp of every class)."""
    prints = materialise(_fingerprints(documents))
    classes = materialise(
        prints.filter("n_shingles > 0").groupBy("_a", "_b", "n_shingles").agg(F.min("_doc").alias("_node"))
        .filter(F.col("_node").isNotNull())
    )
    nodes = classes.select("_a", "_node", F.col("n_shingles").alias("_size"))
    signed = _signed(documents, prints)
    members = materialise(signed.join(nodes, "_a").select("_sig", "_node", "_size"))
    drop(signed)
    wanted = materialise(members.select(F.col("_node").alias("_id")).distinct())
    texts = materialise(_texts(documents, wanted))
    sketches = texts.select(F.col("_id").alias("_node"), "_size", "_sketch").join(
        classes.select("_node", F.col("n_shingles").alias("_size")).distinct(), ["_node", "_size"], "left_semi"
    ).dropDuplicates(["_node"])
    drop(wanted)
    open_, links, tried, comps = members.withColumn("_comp", F.col("_node")), None, None, None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _to_pivot(open_, turn).filter(f"least(_sx, _sy) * {OF} >= greatest(_sx, _sy) * {ALIKE}")
            pairs = pairs.groupBy("_x", "_y").agg(F.count("*").alias("_n"))
        else:
            pairs = _between(open_, sketches)
        if tried is not None:
            pairs = pairs.join(tried, ["_x", "_y"], "left_anti")
        pairs = pairs.select("_x", "_y")
        pairs = materialise(_possible(pairs, sketches) if turn < ROUNDS else pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialise(_verified(pairs, texts))
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        open_ = members.join(comps, "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node"))
        if turn < ROUNDS:
            active = open_.groupBy("_sig").agg(F.min("_comp").alias("l"), F.max("_comp").alias("m")).filter("l != m")
            open_ = materialise(open_.join(active.select("_sig"), "_sig", "left_semi"))
    groups_ = classes.select("_a", "_b", "n_shingles", "_node")
    if comps is None:
        return prints, groups_.withColumnRenamed("_node", "_comp")
    named = materialise(groups_.join(comps, "_node", "left").select("_a", "_b", "n_shingles", F.coalesce("_comp", "_node").alias("_comp")))
    drop(classes, members, texts, comps, *([tried] if ROUNDS == 0 else []))
    return prints, named


def _to_pivot(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a signature's group with the group's pivot, if their components differ."""
    order = F.struct(F.xxhash64(F.col("_node"), F.lit(turn)).alias("o"), "_node", "_comp", "_size")
    pivots = members.groupBy("_sig").agg(F.min(order).alias("_p"))
    return members.join(pivots, "_sig").filter(F.col("_comp") != F.col("_p._comp")).select(
        F.col("_p._node").alias("_x"), F.col("_node").alias("_y"), F.col("_p._size").alias("_sx"), F.col("_size").alias("_sy")
    )


def _families(members: DataFrame) -> DataFrame:
    """_node, _family: members that signatures connect, directly or through others, are a family."""
    pivots = members.groupBy("_sig").agg(F.min("_node").alias("_y"))
    return components(members.join(pivots, "_sig").select(F.col("_node").alias("_x"), "_y")).withColumnRenamed("_comp", "_family")


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows (_node, _family, _size and more) with _block, so that a block has about most rows of like size.

    Blocks are dealt by hash from counts of each family and size, so no family is ordered in one task."""
    like = rows.withColumn("_like", F.floor(F.log(F.col("_size")) / math.log(OF / ALIKE)))
    many = like.groupBy("_family", "_like").agg(F.ceil(F.count("*") / most).alias("_many"))
    block = F.col("_like") * (1 << 40) + F.pmod(F.xxhash64("_node"), F.col("_many"))
    return like.join(many, ["_family", "_like"]).withColumn("_block", block).drop("_like", "_many")


def _between(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs _x, _y of open members of different components that their sketches let pass.

    Families are cut into blocks of about BLOCK members of like size, and blocks of fitting
    sizes are held against each other in one step that returns only what passes; a task holds
    two blocks, however large a family is.
    """
    named = materialise(members.select("_node", "_comp", "_size").distinct().join(_families(members), "_node"))
    blocks = materialise(
        _in_blocks(named, BLOCK).join(sketches.drop("_size"), "_node").groupBy("_family", "_block").agg(  # about BLOCK rows
            F.min("_size").alias("_least"), F.max("_size").alias("_most"), F.min("_comp").alias("_c"), F.max("_comp").alias("_d"),
            F.collect_list(F.struct("_node", "_comp", "_size", "_sketch")).alias("_rows"),
        )
    )
    head = lambda to: blocks.select("_family", *[F.col(f"_{c}").alias(f"_{c}{to}") for c in ("block", "least", "most", "c", "d")])
    pairs = materialise(
        head("x").join(head("y"), "_family").filter(
            f"_blockx <= _blocky and _mostx * {OF} >= _leasty * {ALIKE} and _mosty * {OF} >= _leastx * {ALIKE}"
            " and not (_cx = _dx and _cy = _dy and _cx = _cy)"
        ).select("_family", "_blockx", "_blocky")
    )
    side = lambda to: blocks.select("_family", F.col("_block").alias(f"_block{to}"), F.col("_rows").alias(f"_r{to}"))
    both = pairs.join(side("x"), ["_family", "_blockx"]).join(side("y"), ["_family", "_blocky"]).select("_rx", "_ry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                n = min(len(r["_sketch"]) for r in (*a, *b))
                theirs = folded([r["_sketch"] for r in b], n)
                node, comp, size = (np.array([r[c] for r in b], np.int64) for c in ("_node", "_comp", "_size"))
                found = []
                for r, u in zip(a, folded([r["_sketch"] for r in a], n), strict=True):
                    most = (r["_size"] + size) * (OF - ALIKE) // (OF + ALIKE)
                    at = np.flatnonzero((comp != r["_comp"]) & (node != r["_node"]) & (np.abs(theirs - u).sum(1) <= most))
                    found += [(min(r["_node"], m), max(r["_node"], m)) for m in node[at].tolist()]
                left, right = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["_x", "_y"])

    return both.mapInArrow(run, "_x bigint, _y bigint").distinct()


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Null texts and texts without words have no shingles and are alone. Equal texts have one
    component. Rows that share a doc_id count as one document in links, and all are returned.
    A null doc_id is in the component of its text, if another document has an equal one, else
    its component is null. An empty table gives an empty result; further columns are left out.
    """
    prints, named = linked(documents)
    joined = prints.join(named, ["_a", "_b", "n_shingles"], "left")
    return joined.select(
        F.col("_doc").alias("doc_id"), "n_shingles", F.coalesce("_comp", "_doc").alias("component_id")
    )


def _sets_of(documents: DataFrame) -> DataFrame:
    """_node (fingerprint of the set), _set (its shingles' sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in groups([t or "" for t in texts], 1_000_000):
                found = [(_prints(h)[0], h.tobytes()) for h in _sets(texts[start:end]) if len(h)]
                if found:
                    a, h = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.binary())], names=["_node", "_set"])

    return documents.select("text").mapInArrow(run, "_node bigint, _set binary").dropDuplicates(["_node"])


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """_family, _block, _n, _least, _most (sizes), _rows (_node, _set, _weight): sets that signatures connect, directly
    or through others, in blocks of about LINK_BLOCK sets of like size."""
    placed = materialise(_families(members).join(members.select("_node", "_size").distinct(), "_node"))
    rows = _in_blocks(placed, LINK_BLOCK)
    return materialise(
        rows.join(sets, "_node").groupBy("_family", "_block").agg(
            F.count("*").alias("_n"), F.min("_size").alias("_least"), F.max("_size").alias("_most"),
            F.collect_list(F.struct("_node", "_set", "_weight")).alias("_rows"),
        )
    )


def _counted(a: list[dict], b: list[dict]) -> Iterator[tuple[int, int, int]]:
    """Links between the sets of two blocks, or within one if b is empty: (node, node, documents linked to it here) for
    each set that has any, and (node, other node, 0) for as many links as join the same sets.

    A set's shingles are marked and counted in all sets of the other block at once."""
    rows, begin = [*a, *b], len(a)
    each = [np.frombuffer(r["_set"], np.uint64) for r in rows]
    size = np.array([len(h) for h in each])
    starts = np.concatenate([[0], np.cumsum(size)])
    known, at = np.unique(np.concatenate(each), return_inverse=True)
    node, weight = (np.array([r[c] for r in rows], np.int64) for c in ("_node", "_weight"))
    n, group, mark = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(known), bool)
    for i in range(len(a)):
        first = begin if b else i + 1
        if first == len(rows):
            break
        mine = at[starts[i] : starts[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[at[starts[first] :]], starts[first:-1] - starts[first], dtype=np.int64)
        mark[mine] = False
        like = first + np.flatnonzero(OF * both >= ALIKE * (size[i] + size[first:] - both))
        n[i] += weight[like].sum()
        n[like] += weight[i]
        for m in like[group[like] != group[i]].tolist():
            if group[m] != group[i]:
                yield int(node[i]), int(node[m]), 0
                group[group == group[m]] = group[i]
    yield from ((x, x, c) for x, c in zip(node.tolist(), n.tolist(), strict=True) if c)


def _counted_pairs(blocks: DataFrame) -> DataFrame:
    """_x, _y, _c as _counted gives them, of all blocks of a family whose sizes allow links."""
    head = lambda to: blocks.select("_family", *[F.col(f"_{c}").alias(f"_{c}{to}") for c in ("block", "n", "least", "most")])
    pairs = materialise(
        head("x").join(head("y"), "_family").filter(
            f"(_blockx < _blocky or _blockx = _blocky and _nx > 1) and _mostx * {OF} >= _leasty * {ALIKE} and _mosty * {OF} >= _leastx * {ALIKE}"
        ).select("_family", "_blockx", "_blocky")
    )
    side = lambda to: blocks.select("_family", F.col("_block").alias(f"_block{to}"), F.col("_rows").alias(f"_r{to}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(_counted(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or []))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["_x", "_y", "_c"])

    other = F.when(F.col("_blockx") != F.col("_blocky"), F.col("_ry")).alias("_ry")
    return pairs.join(side("x"), ["_family", "_blockx"]).join(side("y"), ["_family", "_blocky"]).select("_rx", other).mapInArrow(
        run, "_x bigint, _y bigint, _c bigint"
    )


def links(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links (how many other documents are similar to it).

    Rows are as report() has them. Each pair of different sets that share a signature's family and fit in size is compared
    once, in the task that holds their blocks, and counts for all documents of either set; no pair leaves its task. Sets are
    compared by the 64-bit hashes of their shingles, as n_shingles counts them. A document is linked to all others with an
    equal set. doc_id is taken to be unique here; a null one has no links and counts for none.
    """
    prints = materialise(_fingerprints(documents))
    some = prints.filter("n_shingles > 0 and _doc is not null").groupBy("_a", "_b", "n_shingles", "_doc").agg(F.lit(1).alias("_one"))
    classes = materialise(
        some.groupBy("_a", "_b", "n_shingles").agg(F.min("_doc").alias("_least"), F.count("*").alias("_weight"))
    )
    members = materialise(_signed(documents, prints).join(classes.select("_a", F.col("n_shingles").alias("_size")), "_a").withColumnRenamed("_a", "_node"))
    wanted = members.select("_node").distinct().join(classes.select(F.col("_a").alias("_node"), F.col("_least").alias("_id")), "_node")
    held = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").join(
        small_enough(materialise(wanted.select("_id").distinct())), "_id", "left_semi"
    )
    sets = _sets_of(held).join(classes.select(F.col("_a").alias("_node"), "_weight"), "_node")
    found = materialise(_counted_pairs(_blocks(members, sets)).groupBy("_x", "_y").agg(F.sum("_c").alias("_c")))
    counts = found.filter("_x = _y").select(F.col("_x").alias("_a"), "_c")
    name = lambda to: classes.select(F.col("_a").alias(f"_{to}"), F.col("_least").alias(f"_l{to}"))
    ends_ = found.filter("_x != _y").join(name("x"), "_x").join(name("y"), "_y").select(F.col("_lx").alias("_x"), F.col("_ly").alias("_y"))
    comps = components(ends_).withColumnRenamed("_node", "_least")
    unnamed = prints.filter("_doc is null").select("_a", "_b", "n_shingles").distinct().withColumn("_unnamed", F.lit(True))
    told = classes.join(counts, "_a", "left").join(comps, "_least", "left").select(
        "_a", "_b", "n_shingles", F.coalesce("_comp", "_least").alias("_comp"), (F.coalesce("_c", F.lit(0)) + F.col("_weight") - 1).alias("_n")
    )
    told = told.join(unnamed, ["_a", "_b", "n_shingles"], "left").filter("_n > 0 or _unnamed").drop("_unnamed")
    told = small_enough(materialise(told))  # others are alone
    out = prints.join(told, ["_a", "_b", "n_shingles"], "left")
    return out.select(
        F.col("_doc").alias("doc_id"), "n_shingles", F.coalesce("_comp", "_doc").alias("component_id"),
        F.when(F.col("_doc").isNull(), 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without those from which a document of lower doc_id can be reached by links; columns as they were.

    Null texts and texts without words are alone and stay. Of rows with the same doc_id and
    text one stays; rows with the same doc_id and other texts are one document and stay or go
    together. Rows with a null doc_id stay. An empty table gives none.
    """
    found = materialise(report(documents).groupBy("doc_id").agg(F.min("component_id").alias("_least"), F.count("*").alias("_rows")))
    key = fresh("_gone", documents.columns)
    gone = found.filter("_least < doc_id").select(F.col("doc_id").alias(key))
    left = documents.join(small_enough(gone), documents["doc_id"].cast("long") == F.col(key), "left_anti")
    again = found.filter("_rows > 1 and doc_id is not null and _least >= doc_id").select(F.col("doc_id").alias(key))
    if again.isEmpty():
        return left
    of = left["doc_id"].cast("long") == F.col(key)
    return left.join(small_enough(again), of, "left_anti").unionByName(left.join(small_enough(again), of, "left_semi").dropDuplicates(["doc_id", "text"]))


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """The shingles themselves; bytes split on exactly \\x20 and \\x09-\\x0D and lower A-Z alone."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def similar(x: str | None, y: str | None) -> bool:
    s, t = shingle_set(x), shingle_set(y)
    both = len(s & t)
    return bool(s) and bool(t) and OF * both >= ALIKE * (len(s) + len(t) - both)
