"""Chat formatting by quotation linking.

Method: the quote level of each line is the number of ">" before it; runs of one level are
quoted passages. Their normalised lines are hashed (128 bits) and joined, in one conversation, to
the hashed lines that earlier messages wrote themselves. A message answers the message that wrote
most of what it quotes at level one (the latest of several). Answers form threads; each thread
is put in reply order (an answer comes after what it answers) without its quotes.

A line that more than RARE messages of a conversation wrote isn't joined message by message. Messages
with the same set of such common lines are one class; classes meet by line, and of the messages
of all classes that share lines with a class the best so far is a running maximum over turns. So
a line that all messages write and quote costs rows in proportion to the messages, not their pairs.
Messages that share rarer lines are held against that with all their lines counted.

Roots of threads are found by pointer doubling, so a thread of n answers takes log n rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import drop, materialise, small_enough

#: Writers of a line in a conversation up to which they are joined one by one.
RARE = 16
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
MOST_ROUNDS = 40


def level(line: Column) -> Column:
    """Quote level of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def norm(line: Column) -> Column:
    """Lower case, white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    return (
        messages.select("_conv", "_turn", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
        .withColumn("_level", level(F.col("_line")))
        .withColumn("_norm", norm(F.regexp_replace("_line", _MARKS, "")))
        .filter(F.col("_norm") != "")
        .select("_conv", "_turn", "_level", F.unhex(F.md5("_norm")).alias("_hash"))
        .distinct()
    )


def _classes(lines: DataFrame, who: str) -> tuple[DataFrame, DataFrame]:
    """(_conv, who, _class) of each message by its set of common lines, and (_conv, _class, _hash) of each class."""
    told = F.sha2(F.array_join(F.array_sort(F.collect_set(F.hex("_hash"))), ","), 256)
    members = lines.groupBy("_conv", who).agg(told.alias("_class"))
    return members, lines.join(members, ["_conv", who]).select("_conv", "_class", "_hash").distinct()


def _answered(lines: DataFrame) -> DataFrame:
    """_conv, _turn, _to: of each message that quotes an earlier one's lines, the one that wrote most of them, the latest of several."""
    own = lines.filter("_level = 0").select("_conv", F.col("_turn").alias("_from"), "_hash")
    quoted = lines.filter("_level = 1").select("_conv", "_turn", "_hash")
    common = materialise(own.groupBy("_conv", "_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > RARE).select("_conv", "_hash"))
    few = small_enough(common)
    part = lambda df, how: df.join(few, ["_conv", "_hash"], how)
    rare = part(quoted, "left_anti").join(part(own, "left_anti"), ["_conv", "_hash"]).filter("_from < _turn").groupBy("_conv", "_turn", "_from").agg(F.count("*").alias("n"))
    best = lambda df: df.groupBy("_conv", "_turn").agg(F.max(F.struct("n", "_from")).alias("b")).select("_conv", "_turn", F.col("b._from").alias("_to"))
    if common.isEmpty():
        return best(rare)
    writers, written = (materialise(x) for x in _classes(part(own, "left_semi"), "_from"))
    askers, asked = (materialise(x) for x in _classes(part(quoted, "left_semi"), "_turn"))
    shared = materialise(
        asked.withColumnRenamed("_class", "_q").join(written.withColumnRenamed("_class", "_o"), ["_conv", "_hash"]).groupBy("_conv", "_q", "_o").agg(F.count("*").alias("_c"))
    )
    said = shared.join(writers.withColumnRenamed("_class", "_o"), ["_conv", "_o"]).select("_conv", "_q", F.col("_from").alias("_turn"), "_c")
    asks = askers.select("_conv", F.col("_class").alias("_q"), "_turn", F.lit(None).cast("long").alias("_c"))
    before = Window.partitionBy("_conv", "_q").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("n"), F.col("_turn").alias("_from")))).over(before)
    by_common = said.unionByName(asks).withColumn("_best", latest).filter("_c is null and _best is not null").select("_conv", "_turn", "_best._from", "_best.n")
    both = (
        rare.join(askers.withColumnRenamed("_class", "_q"), ["_conv", "_turn"], "left").join(writers.withColumnRenamed("_class", "_o"), ["_conv", "_from"], "left")
        .join(shared, ["_conv", "_q", "_o"], "left").select("_conv", "_turn", "_from", (F.col("n") + F.coalesce("_c", F.lit(0))).alias("n"))
    )
    out = materialise(best(both.unionByName(by_common)))
    drop(common, writers, written, askers, asked, shared)
    return out


def unquoted(text: Column) -> Column:
    """The lines that the message wrote itself, without blank lines at both ends."""
    own = F.filter(F.split(text, "\n", -1), lambda x: level(x) == 0)
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted (quoted lines), reply_to, thread, position.

    Every line behind ">" is a quote and leaves the text, whether or not its original is found;
    n_quoted tells how many did. Null texts are empty. Rows with a null conv_id or turn answer nothing and stand alone, at
    position 1 of a thread of their own turn. Of rows with one conv_id and turn, one (the least
    by role and text) is kept. An empty table gives none; further columns are left out.
    """
    source = messages.select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.coalesce("text", F.lit("")).alias("_text")
    )
    whole = (
        source.groupBy("_conv", "_turn").agg(F.min(F.struct("_role", "_text")).alias("m"))
        .select("_conv", "_turn", F.col("m._role").alias("_role"), F.col("m._text").alias("_text"))
    )
    whole = materialise(whole)
    lines = materialise(_lines(whole))
    met = _answered(lines)
    n_quoted = materialise(lines.filter("_level > 0").groupBy("_conv", "_turn").agg(F.count("*").alias("_quoted")))
    up = materialise(
        whole.select("_conv", "_turn").join(met, ["_conv", "_turn"], "left").select(
            "_conv", "_turn", F.col("_to"), F.coalesce("_to", "_turn").alias("_root")
        )
    )
    drop(lines)
    before = up
    for _ in range(MOST_ROUNDS):
        above = up.select("_conv", F.col("_turn").alias("_root"), F.col("_root").alias("_next"))
        more = materialise(
            up.join(above, ["_conv", "_root"], "left").select("_conv", "_turn", "_to", F.coalesce("_next", "_root").alias("_new"), F.col("_root").alias("_old"))
        )
        changed = not more.filter("_new <> _old").isEmpty()
        drop(before)
        before = more
        up = more.select("_conv", "_turn", "_to", F.col("_new").alias("_root"))
        if not changed:
            break
    position = F.row_number().over(Window.partitionBy("_conv", "_root").orderBy("_turn"))
    placed = up.withColumn("_position", position)
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    joined = whole.alias("a").join(placed.alias("b"), same("_conv", "_conv") & same("_turn", "_turn"))
    joined = joined.select("a._conv", "a._turn", "_role", "_text", "_to", "_root", "_position").alias("a").join(
        n_quoted.alias("b"), same("_conv", "_conv") & same("_turn", "_turn"), "left"
    )
    return joined.select(
        F.col("a._conv").alias("conv_id"), F.col("a._turn").alias("turn"), F.col("_role").alias("role"),
        unquoted(F.col("_text")).alias("text"), F.coalesce("_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.col("_to").alias("reply_to"), F.col("_root").alias("thread"), F.col("_position").cast("long").alias("position"),
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail would carry them: a turn, but for each fourth, quotes the turn
    before it, and each third also what that one answered, one level deeper.

    Null texts are empty ones; a turn whose predecessor isn't there quotes nothing; repeated rows of
    a turn quote and are quoted once each; an empty table gives none; further columns are left out.
    """
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    prior = lambda n, name: c.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    both = c.join(prior(1, "_one"), ["conv_id", "turn"], "left").join(prior(2, "_two"), ["conv_id", "turn"], "left")
    mark = lambda t, m: F.concat(F.lit(m), F.replace(t, F.lit("\n"), F.lit("\n" + m)), F.lit("\n"))
    deep = F.when((F.col("turn") % 3 == 2) & F.col("_two").isNotNull(), mark(F.col("_two"), "> > ")).otherwise("")
    quote = F.when((F.col("turn") % 4 != 3) & F.col("_one").isNotNull(), F.concat(deep, mark(F.col("_one"), "> "))).otherwise("")
    return both.select("conv_id", "turn", "role", F.concat(quote, F.col("text")).alias("text"))
