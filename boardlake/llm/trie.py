"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns (role, text). A turn is told by its SHA-256, a sequence by two 64-bit sums
(exclusive or) of hashes of turn and place, which are running sums and so need no task for a whole conversation.

Contraction. Every node has two values; the totals over each node's subtree are wanted. A round compresses every chain of
nodes with one child: by pointer doubling each learns the chain's bottom and the sum of the values down to it, the chain
goes, and its bottom hangs from what was above the chain, with the chain's sum on its link. Then the round rakes: every
leaf's total is known, goes to its parent and the leaf goes. What is left has at most half the leaves, so rounds are few,
and doubling takes the logarithm of the longest chain. At the end the chains are opened again in reverse order of rounds:
a chain's node has the total of the bottom and its own sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import drop, materialise, numbered

#: Turns of a block, in which running sums are made; blocks are then put one after the other.
BLOCK = 1024
#: Conversations that share a base, and the number that the shared turns stay below.
FAMILY, MOST_SHARED = 5, 9


def _turn(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """_conv, _depth (1, 2, ... by turn, null first, then by the turn's hash), _turn (hash), _bytes of the text.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out, as are other columns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_at"), _turn(role, text).alias("_turn"), F.octet_length(text).cast("long").alias("_bytes")
    )
    return numbered(rows, "_conv", "_at", "_turn").withColumnRenamed("_pos", "_depth").drop("_at")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns() of conversations that take their first turns from the base of their family of five, and (_conv, _len) of all.

    Conversation c has the first crc32(c) % 9 turns of c - c % 5, then its own from there on. Shared turns are at most eight,
    so a base of any length sends eight rows to each of its family.
    """
    own = materialise(own)
    shared = F.crc32(F.col("_conv").cast("string")) % MOST_SHARED
    convs = materialise(own.groupBy("_conv").agg(F.max("_depth").alias("_n")))
    base = convs.withColumnRenamed("_conv", "_base").withColumnRenamed("_n", "_of_base")
    known = materialise(
        convs.withColumn("_shared", shared).join(base, F.col("_conv") - F.col("_conv") % FAMILY == F.col("_base"), "left").select(
            "_conv", "_base", "_shared", F.least("_shared", F.coalesce("_of_base", F.lit(0))).alias("_taken"), "_n"
        )
    )
    heads = own.filter(F.col("_depth") < MOST_SHARED).withColumnRenamed("_conv", "_base")
    taken = known.select("_conv", "_base", "_taken").join(heads, "_base").filter("_depth <= _taken").select("_conv", "_depth", "_turn", "_bytes")
    later = own.join(known.select("_conv", "_shared", "_taken"), "_conv").filter("_depth > _shared").select(
        "_conv", (F.col("_depth") - F.col("_shared") + F.col("_taken")).alias("_depth"), "_turn", "_bytes"
    )
    return taken.unionByName(later), known.select("_conv", (F.col("_taken") + F.greatest(F.lit(0), F.col("_n") - F.col("_shared"))).alias("_len"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """rows with _x, _y, which tell the sequence up to here, and _px, _py, the sequence before."""
    block = F.floor(F.col("_depth") / BLOCK)
    each = rows.withColumns({"_hx": F.xxhash64("_depth", "_turn"), "_hy": F.xxhash64("_turn", "_depth", F.lit(1)), "_block": block}).drop("_turn")
    long = each.filter("_block > 0").select("_conv").distinct()
    sums = each.join(long, "_conv", "left_semi").groupBy("_conv", "_block").agg(F.bit_xor("_hx").alias("_sx"), F.bit_xor("_hy").alias("_sy"))
    ahead = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_conv", "_block", *[F.bit_xor(f"_s{c}").over(ahead).alias(f"_b{c}") for c in "xy"]).filter("_block > 0")
    within = Window.partitionBy("_conv", "_block").orderBy("_depth").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.bit_xor(f"_h{c}").over(within).bitwiseXOR(F.coalesce(f"_b{c}", F.lit(0)))
    out = each.join(before, ["_conv", "_block"], "left").withColumns({"_x": run("x"), "_y": run("y")})
    return out.withColumns({"_px": F.col("_x").bitwiseXOR(F.col("_hx")), "_py": F.col("_y").bitwiseXOR(F.col("_hy"))}).drop(
        "_block", "_hx", "_hy", "_bx", "_by"
    )


def _hashed(ends: DataFrame) -> DataFrame:
    """_depth, _x, _y, _ends: SHA-256 of each node's _conv in order, comma-joined. Rows come sorted and are hashed as they pass,
    so a node of any number of conversations takes no memory."""
    names = ["_depth", "_x", "_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if node != now:
                    if now:
                        out.append([*now, state.hexdigest()])
                    now, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if out:
                yield _batch(out)
        if now:
            yield _batch([[*now, state.hexdigest()]])

    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "_ends"])

    kinds = [pa.int64()] * 3 + [pa.string()]
    rows = ends.select(*[F.col(c).cast("long") for c in names], "_conv").repartition(*names).sortWithinPartitions(*names, "_conv")
    return rows.mapInArrow(run, "_depth bigint, _x bigint, _y bigint, _ends string")


def _chains(alive: DataFrame) -> DataFrame:
    """Nodes with one child, but for the root: _id, _parent, _to (the chain's bottom), _la, _lb (sums down to it, without it),
    _ea, _eb (sums of what was compressed above the node before)."""
    chains = materialise(
        alive.filter("_kids = 1 and _parent is not null").select(
            "_id", "_parent", F.col("_child").alias("_to"), (F.col("_a") + F.col("_ka")).alias("_la"), (F.col("_b") + F.col("_kb")).alias("_lb"), "_ea", "_eb"
        )
    )
    more = not chains.isEmpty()
    while more:
        step = chains.select(F.col("_id").alias("_n"), F.col("_to").alias("_nto"), F.col("_la").alias("_na"), F.col("_lb").alias("_nb"))
        add = lambda c: (F.col(f"_l{c}") + F.coalesce(f"_n{c}", F.lit(0))).alias(f"_l{c}")
        far = materialise(
            chains.join(step, F.col("_to") == F.col("_n"), "left").select(
                "_id", "_parent", F.coalesce("_nto", "_to").alias("_to"), add("a"), add("b"), "_ea", "_eb", F.col("_n").isNotNull().alias("_moved")
            )
        )
        drop(chains)
        chains, more = far.drop("_moved"), not far.filter("_moved").isEmpty()
        chains._written_to = far._written_to
    return chains


def subtree_totals(tree: DataFrame) -> DataFrame:
    """_id, _a, _b: sums over the subtree of each node of tree (_id, _parent, _a, _b; one or more roots have no parent)."""
    alive = materialise(tree.select("_id", "_parent", "_a", "_b", F.lit(0).cast("long").alias("_ea"), F.lit(0).cast("long").alias("_eb")))
    raked, rounds, used = [], [], []
    while not alive.isEmpty():
        kids = alive.filter("_parent is not null").groupBy(F.col("_parent").alias("_of")).agg(
            F.count("*").alias("_kids"), F.min("_id").alias("_child"), F.sum("_ea").alias("_ka"), F.sum("_eb").alias("_kb")
        )
        state = materialise(alive.join(kids, F.col("_id") == F.col("_of"), "left").drop("_of").fillna(0, ["_kids"]))
        chains = _chains(state)
        rounds.append(chains)
        tops = chains.join(chains.select(F.col("_id").alias("_above")), F.col("_parent") == F.col("_above"), "left_anti").select(
            F.col("_to").alias("_bottom"), F.col("_parent").alias("_up"), (F.col("_la") + F.col("_ea")).alias("_ca"), (F.col("_lb") + F.col("_eb")).alias("_cb")
        )
        left = materialise(
            state.filter("_kids != 1 or _parent is null").join(tops, F.col("_id") == F.col("_bottom"), "left").select(
                "_id", F.coalesce("_up", "_parent").alias("_parent"), "_a", "_b", F.coalesce("_ca", "_ea").alias("_ea"), F.coalesce("_cb", "_eb").alias("_eb"), "_kids"
            )
        )
        leaves = left.filter("_kids = 0")
        raked.append(leaves.select("_id", "_a", "_b"))
        given = leaves.filter("_parent is not null").groupBy(F.col("_parent").alias("_of")).agg(F.sum(F.col("_a") + F.col("_ea")).alias("_ga"), F.sum(F.col("_b") + F.col("_eb")).alias("_gb"))
        add = lambda c: (F.col(f"_{c}") + F.coalesce(f"_g{c}", F.lit(0))).alias(f"_{c}")
        before, alive = alive, materialise(
            left.filter("_kids > 0").join(given, F.col("_id") == F.col("_of"), "left").select("_id", "_parent", add("a"), add("b"), "_ea", "_eb")
        )
        drop(before, state)
        used += [chains, left]
    if not raked:
        return tree.select("_id", "_a", "_b")
    known = reduce(DataFrame.unionByName, raked)
    for chains in reversed(rounds):
        total = known.select(F.col("_id").alias("_n"), F.col("_a").alias("_ta"), F.col("_b").alias("_tb"))
        opened = materialise(
            chains.join(total, F.col("_to") == F.col("_n")).select("_id", (F.col("_la") + F.col("_ta")).alias("_a"), (F.col("_lb") + F.col("_tb")).alias("_b"))
        )
        used.append(opened)
        known = known.unionByName(opened)
    out = materialise(known)
    drop(alive, *used)
    return out


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefixes of rows (_conv, _depth, _turn, _bytes); convs (_conv, _len) names every conversation.

    conv_id (least member; with depth it names the node), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. An empty table has no node; a conversation without turns is a member of the root alone.
    """
    found = _prefixes(rows)
    nodes = found.groupBy("_depth", "_x", "_y").agg(
        F.min("_conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("_px").alias("_px"), F.first("_py").alias("_py"), F.first("_bytes").alias("_bytes")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("_conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("_depth"), zero.alias("_x"), zero.alias("_y"), "conv_id", "n_convs", F.lit(None).cast("long").alias("_px"), F.lit(None).cast("long").alias("_py"), zero.alias("_bytes"))
    nodes = materialise(nodes.select(root.columns).unionByName(root).withColumn("_id", F.monotonically_increasing_id()))
    above = nodes.select((F.col("_depth") + 1).alias("_depth"), F.col("_x").alias("_px"), F.col("_y").alias("_py"), F.col("_id").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    hung = materialise(nodes.join(above, ["_depth", "_px", "_py"], "left"))
    children = hung.filter("_parent is not null").groupBy(F.col("_parent").alias("_id")).agg(F.count("*").alias("n_children"))
    full = materialise(hung.join(children, "_id", "left").fillna(0, ["n_children"]))
    values = full.select("_id", "_parent", (F.col("n_children") == 0).cast("long").alias("_a"), ((F.col("n_convs") - 1) * F.col("_bytes")).alias("_b"))
    totals = subtree_totals(values).select("_id", F.col("_a").alias("n_leaves"), F.col("_b").alias("saved_tokens"))
    last = found.join(convs.filter("_len > 0").select("_conv", F.col("_len").alias("_depth")), ["_conv", "_depth"]).select("_depth", "_x", "_y", "_conv")
    ends = _hashed(last.unionByName(convs.filter("_len = 0").select(zero.alias("_depth"), zero.alias("_x"), zero.alias("_y"), "_conv")))
    out = full.join(totals, "_id").join(ends, ["_depth", "_x", "_y"], "left")
    return out.select(
        "conv_id", F.col("_depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("_ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    rows = materialise(turns(conversations))
    return trie(rows, rows.groupBy("_conv").agg(F.max("_depth").alias("_len")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share first turns in families (see rebuilt)."""
    rows, convs = rebuilt(turns(conversations))
    rows, convs = materialise(rows), materialise(convs)
    return trie(rows, convs)
