"""Locations: text to entries of city, state and country, and predicates on one entry.

A location text is parsed once however many postings carry it: distinct texts, column
expressions, join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.constants import COUNTRIES, NO_TOWNS, STATES
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

_REMOTE = r"(?i)\bremote\b|work from home|\bwfh\b"


def work_mode(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)\bhybrid\b"), "hybrid").when(c.rlike(_REMOTE), "remote").otherwise("non_remote")


def _map(d: dict[str, str]) -> Column:
    """A constant map, written as one text so that plans stay small."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in d.items())), F.lit(";"), F.lit("="))


_MODES = r"(?i)\b(remote|hybrid|on[- ]?site|work from home|wfh|based|only)\b|[()\[\]]"
_ZIP = r"\s+(?:\d{5}(?:-\d{4})?|[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d)$"
_ENTRY = "struct<city:string,state:string,country:string>"


def _town(part: Column) -> Column:
    """A part of a location without words for how one works."""
    return F.trim(F.regexp_replace(F.regexp_replace(part, _MODES, " "), r"\s+", " "))


def entries(c: Column) -> Column:
    """Array of (city, state, country) of a location text; of groups between ; / and | the first 40 are read, as a limit of the format.

    A group's parts stand between commas or after a dash. Where a part is a state, the part before it is its town, and a run of
    towns and states is read pair by pair; a state by name with another state behind it is a town. A country that isn't the US
    ends the group: then no part is a state. Without such pairs the group gives one entry, whose town may have its state's name
    (up to three words, the longest first) behind it. A town that is called like its state is the state alone.
    """
    codes, names, countries = _map({k.lower(): k for k in STATES}), _map({v.lower(): k for k, v in STATES.items()}), _map(COUNTRIES)
    state_names = _map({k: v.lower() for k, v in STATES.items()})
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(hybrid|remote|on-?site)\b\s*-?|(?-i:\bor\s*$|\bor(?=\s+[Rr]emote))", " ")
    groups = F.slice(F.split(text, r"[;/|]"), 1, 40)
    entry = lambda city, state, country: F.struct(city.alias("city"), state.alias("state"), country.alias("country"))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    code = lambda part: F.coalesce(codes[F.lower(part)], names[F.lower(part)])

    def plausible(town: Column, state: Column) -> Column:
        low = F.lower(town)
        return (
            F.length(town).between(2, 60) & (F.size(F.split(town, " ")) <= 5) & ~low.isin(*NO_TOWNS) & ~town.rlike(r"\d") & town.rlike(r"\p{L}")
            & ~low.rlike("^[a-z] ?[a-z]$") & countries[low].isNull() & (F.coalesce(state_names[state], F.lit("")) != low)
        )

    def pairs(parts: Column) -> Column:
        """Pairs of a town and a state; acc has them and the place that the next may begin at."""
        state_at = lambda i: let(
            F.struct(F.get(parts, i).alias("x"), F.get(parts, i + 1).alias("y")),
            lambda p: F.when(codes[F.lower(p["x"])].isNotNull() | code(p["y"]).isNull() | (code(p["y"]) == code(p["x"])), code(p["x"])),
        )

        def step(acc: Column, i: Column) -> Column:
            return let(
                F.struct(_town(F.get(parts, i)).alias("town"), state_at(i + 1).alias("state")),
                lambda p: F.when(
                    (i >= acc["next"]) & p["state"].isNotNull() & F.coalesce(plausible(p["town"], p["state"]), F.lit(False)),
                    F.struct(F.concat(acc["found"], F.array(entry(p["town"], p["state"], F.lit("US")))).alias("found"), (i + 2).alias("next")),
                ).otherwise(acc),
            )

        start = F.struct(F.array().cast(f"array<{_ENTRY}>").alias("found"), F.lit(0).alias("next"))
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda acc: acc["found"])

    def one(parts: Column, country: Column, foreign: Column) -> Column:
        state = F.when(~foreign, F.get(F.filter(F.transform(parts, code), lambda s: s.isNotNull()), F.lit(0)))

        def with_town(told: Column) -> Column:
            towns = F.filter(F.transform(parts, _town), lambda t: F.coalesce(plausible(t, told["state"]), F.lit(False)))
            return let(F.get(towns, F.lit(0)), lambda town: let(F.when(told["state"].isNull() & ~foreign, F.split(town, " ")), lambda w: fused(town, w, told["state"])))

        def fused(town: Column, words: Column, state: Column) -> Column:
            tail = lambda n: F.when(F.size(words) > n, F.struct(names[F.lower(F.array_join(F.slice(words, -n, n), " "))].alias("s"), F.lit(n).alias("n")))
            found = F.get(F.filter(F.array(tail(3), F.when(F.size(words) > 2, tail(2)), F.when(F.size(words) > 1, tail(1))), lambda t: t["s"].isNotNull()), F.lit(0))
            return let(
                found,
                lambda f: entry(
                    F.when(f["s"].isNotNull(), F.array_join(F.slice(words, F.lit(1), F.size(words) - f["n"]), " ")).otherwise(town),
                    F.coalesce(state, f["s"]), F.coalesce(country, F.when(F.coalesce(state, f["s"]).isNotNull(), "US")),
                ),
            )

        return let(F.struct(state.alias("state")), with_town)

    def parse(g: Column) -> Column:
        slug = F.regexp_extract(F.trim(g), r"^US-([A-Z]{2})-(.+)$", 1)
        us = F.array(entry(F.regexp_extract(F.trim(g), r"^US-([A-Z]{2})-(.+)$", 2), slug, F.lit("US")))
        parts = F.filter(F.transform(F.split(F.translate(g, "()[]", "    "), r",|\s*-\s+"), lambda p: F.trim(F.regexp_replace(F.trim(p), _ZIP, ""))), lambda p: p != "")

        def read(parts: Column) -> Column:
            country = countries[F.lower(_town(F.try_element_at(parts, F.lit(-1))))]
            foreign = F.coalesce(country != "US", F.lit(False))
            rest = F.when(country.isNotNull(), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
            return let(
                F.struct(rest.alias("rest"), country.alias("country"), foreign.alias("foreign")),
                lambda p: let(
                    F.when(~p["foreign"], pairs(p["rest"])),
                    lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(one(p["rest"], p["country"], p["foreign"]))),
                ),
            )

        return F.when(slug != "", us).otherwise(let(parts, read))

    return F.filter(
        F.array_distinct(F.flatten(F.transform(F.filter(groups, lambda g: F.trim(g) != ""), parse))),
        lambda e: e["city"].isNotNull() | e["state"].isNotNull() | e["country"].isNotNull(),
    )


def parse_location(c: Column) -> Column:
    """Struct of primary (the first entry with a city), is_remote and locations of a text, of which 4,000 characters are read."""
    text = F.substring(F.coalesce(c, F.lit("")), 1, 4000)
    found = entries(text)
    return F.struct(
        F.try_element_at(F.filter(found, lambda e: e["city"].isNotNull()), F.lit(1)).alias("primary"), text.rlike(_REMOTE).alias("is_remote"), found.alias("locations")
    )


def per_distinct(df: DataFrame, column: str, name: str, make) -> DataFrame:
    """df with make(column) as name, computed once for each distinct value; the join stays a shuffle
    unless Spark finds the distinct values small."""
    values = df.select(column).distinct().withColumn(name, make(F.col(column)))
    key = f"_{column}"
    return df.join(values.withColumnRenamed(column, key), df[column].eqNullSafe(F.col(key)), "left").drop(key)


def has_state(found: Column, state: str) -> Column:
    """Whether one and the same entry is in the state of the country US."""
    return F.exists(found, lambda e: (e["state"] == state) & (e["country"] == "US"))


#: What the sixteen locations hold: text, position, city, state, country.
_ANSWERS = """answers(location, city, state, country) AS (VALUES ('Seattle, WA', 'Seattle', 'WA', 'US'), ('Kent, WA', 'Kent', 'WA', 'US'),
('Perth, WA, Australia', 'Perth', NULL, 'AU'), ('US-WA-Redmond', 'Redmond', 'WA', 'US'), ('Washington, DC', 'Washington', 'DC', 'US'),
('Remote - USA', NULL, NULL, 'US'), ('Denver, CO; Austin, TX', 'Denver', 'CO', 'US'), ('Denver, CO; Austin, TX', 'Austin', 'TX', 'US'),
('Berlin, Germany', 'Berlin', NULL, 'DE'), ('Hybrid - Boston, MA', 'Boston', 'MA', 'US'), ('London, United Kingdom', 'London', NULL, 'GB'),
('Portland, OR 97201', 'Portland', 'OR', 'US'), ('Mumbai, India', 'Mumbai', NULL, 'IN'), ('Chicago, IL or Remote', 'Chicago', 'IL', 'US'),
('Florence Kentucky', 'Florence', 'KY', 'US'))"""


def located(spark, sf_dir) -> DataFrame:
    return per_distinct(postings(spark, sf_dir), "location", "entries", entries)


@query(f"WITH {POSTINGS}, {_ANSWERS} SELECT posting_id, city, state, country FROM postings JOIN answers USING (location)")
def ge_parse_location(spark, sf_dir) -> DataFrame:
    return located(spark, sf_dir).select("posting_id", F.explode("entries").alias("e")).select("posting_id", "e.city", "e.state", "e.country")


@query(f"WITH {POSTINGS}, {_ANSWERS} SELECT DISTINCT posting_id, location FROM postings JOIN answers USING (location) WHERE state = 'WA' AND country = 'US'")
def ge_state_filter(spark, sf_dir) -> DataFrame:
    return located(spark, sf_dir).filter(has_state(F.col("entries"), "WA")).select("posting_id", "location")


@query(
    f"""WITH {POSTINGS} SELECT CASE WHEN regexp_matches(location, '(?i)\\bhybrid\\b') THEN 'hybrid'
WHEN regexp_matches(location, '(?i)\\bremote\\b|work from home|\\bwfh\\b') THEN 'remote' ELSE 'non_remote' END AS mode, count(*) AS n FROM postings GROUP BY 1"""
)
def ge_work_mode(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).groupBy(work_mode(F.col("location")).alias("mode")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POSTINGS}, {_ANSWERS}, c AS (SELECT state, city, count(*) AS n FROM postings JOIN answers USING (location) WHERE state IS NOT NULL GROUP BY 1, 2)
SELECT state, city, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, city) AS rank FROM c) WHERE rank <= 60"""
)
def wn_top_cities(spark, sf_dir) -> DataFrame:
    """The sixty towns of each state with most postings. Postings are counted by their location text before it is parsed."""
    counts = (
        by_location(postings(spark, sf_dir)).select("n", F.explode("entries").alias("e")).filter("e.state is not null")
        .groupBy("e.state", "e.city").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "city")).cast("long")
    return counts.withColumn("rank", rank).filter("rank <= 60")


def by_location(df: DataFrame) -> DataFrame:
    """location, n (postings), entries: one row for each location text, however many postings have it."""
    return df.groupBy("location").agg(F.count("*").alias("n")).withColumn("entries", entries(F.col("location")))


@query(
    f"""WITH {POSTINGS}, {_ANSWERS}, p AS (SELECT DISTINCT posting_id, state FROM postings JOIN answers USING (location) WHERE state IS NOT NULL)
SELECT s.state, coalesce(n, 0) AS n FROM (SELECT unnest({list(STATES)}) AS state) s LEFT JOIN (SELECT state, count(*) AS n FROM p GROUP BY state) c USING (state)"""
)
def ag_state_counts(spark, sf_dir) -> DataFrame:
    """Postings for each of the 51 codes, zero included."""
    states = F.array_distinct(F.transform(F.filter("entries", lambda e: e["state"].isNotNull()), lambda e: e["state"]))
    found = by_location(postings(spark, sf_dir)).select("n", F.explode(states).alias("state")).groupBy("state").agg(F.sum("n").alias("n"))
    codes = spark.createDataFrame([(s,) for s in STATES], "state string")
    return codes.join(found, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH {POSTINGS}, {_ANSWERS}, f AS (SELECT location, min_by(city, k) AS city, min_by(state, k) AS state FROM (SELECT *, row_number() OVER () AS k FROM answers) WHERE city IS NOT NULL GROUP BY 1)
SELECT posting_id, city, state, coalesce(regexp_matches(location, '(?i)\\bremote\\b|work from home|\\bwfh\\b'), false) AS is_remote FROM postings LEFT JOIN f USING (location)"""
)
def ge_primary(spark, sf_dir) -> DataFrame:
    """First town of every posting's location, and whether it can be remote."""
    found = per_distinct(postings(spark, sf_dir), "location", "p", parse_location)
    return found.select("posting_id", "p.primary.city", "p.primary.state", "p.is_remote")


#: Groups of parts of each customer's location in SQL; {t} a town, {s} a state's code, {n} its name, {r} and {m} of another state.
_RUNS = """CASE c_custkey % 10 WHEN 0 THEN {t} || ', ' || {s} || ', Other ' || {t} || ', ' || {r} WHEN 1 THEN {t} || ' ' || {n} WHEN 2 THEN {t} || ', ' || {n} || ', USA' WHEN 3 THEN {t} || ', ' || {s} || ' 12345-6789; ' || {n}
WHEN 4 THEN {t} || ', ' || {s} || ', Australia' WHEN 5 THEN 'Remote - ' || {t} || ', ' || {s} WHEN 6 THEN {n} || ', ' || {r} WHEN 7 THEN {t} || ', ' || {s} || ', ' || {t} || ', ' || {s} || ' / Hybrid (' || {t} || ')'
WHEN 8 THEN {s} || ' - ' || {t} ELSE {t} || ', ' || {n} || ', ' || {r} || ', US' END"""
_STATE_ROWS = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(STATES.items()))
_RUN_SQL = f"""st(i, code, name) AS (VALUES {_STATE_ROWS}), w AS (SELECT c_custkey, c_custkey % 10 AS k, a.code AS s, a.name AS n, b.code AS r, b.name AS m, 'Town' || translate(CAST(c_custkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') AS t
FROM customer JOIN st a ON a.i = c_custkey // 10 % 51 JOIN st b ON b.i = (c_custkey // 10 + 7) % 51)"""


@query(
    f"""WITH {_RUN_SQL}, e AS (
SELECT c_custkey, t AS city, s AS state, 'US' AS country FROM w WHERE k IN (0, 1, 2, 3, 5, 7, 8)
UNION ALL SELECT c_custkey, 'Other ' || t, r, 'US' FROM w WHERE k = 0 UNION ALL SELECT c_custkey, NULL, s, 'US' FROM w WHERE k = 3
UNION ALL SELECT c_custkey, t, NULL, 'AU' FROM w WHERE k = 4 UNION ALL SELECT c_custkey, n, r, 'US' FROM w WHERE k = 6
UNION ALL SELECT c_custkey, t, NULL, NULL FROM w WHERE k = 7 UNION ALL SELECT c_custkey, n, r, 'US' FROM w WHERE k = 9)
SELECT c_custkey, city, state, country FROM e"""
)
def ge_runs(spark, sf_dir) -> DataFrame:
    """Entries of every customer's location: runs of towns and states, names of states behind towns, ZIP codes, foreign countries."""
    states = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in STATES.items()])
    at = lambda step: F.get(states, ((F.expr("c_custkey div 10") + step) % len(STATES)).cast("int"))
    town = F.concat(F.lit("Town"), F.translate((F.col("c_custkey") % 97).cast("string"), "0123456789", "abcdefghij"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", town.alias("t"), at(0).alias("_x"), at(7).alias("_y"))
    rows = rows.selectExpr("c_custkey", _RUNS.format(t="t", s="_x.c", n="_x.n", r="_y.c", m="_y.n") + " AS location")
    return per_distinct(rows, "location", "entries", entries).select("c_custkey", F.explode("entries").alias("e")).select("c_custkey", "e.*")
