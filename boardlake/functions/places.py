"""Filters on places as users write them, read on the driver, and the predicate that they make on a posting's location."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import COUNTRIES, COUNTRY_NAMES, COUNTRY_REGIONS, EXTRACT_COUNTRIES, STATES
from boardlake.functions.geo import entries, per_distinct
from boardlake.functions.hiring import infer_geo
from boardlake.functions.text import geo_text, like_text
from boardlake.registry import query

_STATE_NAMES = {v.lower(): k for k, v in STATES.items()}
#: Kinds of counties.
COUNTY_KINDS = r"\b(county|parish|borough|census area|municipality)\b"


def _plain(text: str) -> str:
    """geo_text of a filter's own text."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).replace("&", " and ")
    return re.sub(r"[^a-z0-9]+", " ", re.sub("['’]", "", bare)).strip()


def _once(values: list) -> list:
    return list(dict.fromkeys(values))


def state_filters(values: list[str]) -> list[str]:
    """Codes of states from codes or names, each once; what is no state is left out."""
    found = [v.strip().upper() if v.strip().upper() in STATES else _STATE_NAMES.get(_plain(re.sub(r"(?i)\bstate\b", " ", v)), "") for v in values]
    return _once([c for c in found if c])


def country_filters(values: list[str]) -> list[str]:
    """Codes from codes or names, and RAW:text for what is no known country; stored RAW values become codes where they can."""
    out = []
    for value in filter(None, map(str.strip, values)):
        bare = _plain(value[4:] if value.lower().startswith("raw:") else value)
        code = value.upper() if value.upper() in COUNTRY_NAMES else COUNTRIES.get(bare)
        out.append(code or (f"RAW:{bare}" if len(bare) > 2 else ""))
    return _once([x for x in out if x])


def region_filters(values: list[str]) -> list[str]:
    return _once([v.strip().upper() for v in values if v.strip().upper() in set(COUNTRY_REGIONS.values())])


def county_filters(values: list[str]) -> list[tuple[str, str]]:
    """(state or "", county) of "County" or "ST|County"."""
    out = []
    for value in values:
        state, _, county = value.rpartition("|")
        name = " ".join(re.sub(COUNTY_KINDS, "", county.lower()).split())
        if name:
            out.append((state.strip().upper(), name))
    return out


@dataclass(frozen=True)
class Town:
    """A city that may be bound to a state or country."""

    city: str
    state: str = ""
    country: str = ""


def city_filters(values: list[str]) -> list[Town]:
    """Towns of "City", "City, ST", "City, ST, Country" or "City|ST", each once."""
    out = []
    for value in values:
        parts = [p for p in map(str.strip, value.replace("|", ",").split(",")) if p]
        if not parts or not (city := _plain(parts[0])):
            continue
        state = country = ""
        for part in parts[1:]:
            code = part.upper() if part.upper() in STATES else _STATE_NAMES.get(_plain(part), "")
            if code and not state:
                state = code
            else:
                country = country or COUNTRIES.get(_plain(part), "")
        out.append(Town(city, state, country))
    return _once(out)


def in_town(found: Column, towns: list[Town]) -> Column:
    """Whether one entry is in one of the towns, in the state and country that it is bound to."""

    def meets(e: Column) -> Column:
        any_ = F.lit(False)
        for t in towns:
            ok = geo_text(F.coalesce(e["city"], F.lit(""))) == t.city
            if t.state:
                ok = ok & F.coalesce(e["state"] == t.state, F.lit(False))
            if t.country:
                ok = ok & F.coalesce(e["country"] == t.country, F.lit(True))
            any_ = any_ | ok
        return any_

    return F.coalesce(F.exists(found, meets), F.lit(False))


def in_place(
    text: Column, found: Column, geo: Column, states: list[str] = (), counties: list[tuple[str, str]] = (), countries: list[str] = (), regions: list[str] = ()
) -> Column:
    """All kinds of places that are asked for, any of each kind; a blank location fails as soon as one is asked for.

    found are the location's entries, geo its country and region.
    """
    if not (states or counties or countries or regions):
        return F.lit(True)
    in_state = lambda code: F.exists(found, lambda e: (e["state"] == code) & (F.coalesce(e["country"], F.lit("US")) == "US"))
    words = F.concat(F.lit(" "), geo_text(text), F.lit(" "))
    ok = [F.trim(F.coalesce(text, F.lit(""))) != ""]
    if states:
        ok.append(reduce(Column.__or__, [in_state(s) for s in states]))
    if counties:
        ok.append(reduce(Column.__or__, [like_text(text).contains(name) & (in_state(state) if state else F.lit(True)) for state, name in counties]))
    if countries:
        known = {c: [n for n, code in COUNTRIES.items() if code == c and len(n) > 2] for c in countries if not c.startswith("RAW:")}
        named = [words.contains(f" {n} ") for names in known.values() for n in names] + [words.contains(f" {c[4:]} ") for c in countries if c.startswith("RAW:")]
        ok.append(reduce(Column.__or__, named, F.coalesce(geo["country"].isin(list(known)), F.lit(False)) if known else F.lit(False)))
    if regions:
        ok.append(F.coalesce(geo["region"].isin(list(regions)), F.lit(False)))
    return F.coalesce(reduce(Column.__and__, ok), F.lit(False))


def simple_country(text: Column) -> Column:
    """Country name of the extract: the first of its few names that occurs, else United States by a state code in the last two parts."""
    low, parts = F.lower(F.coalesce(text, F.lit(""))), F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    named = [F.when(low.contains(n), country) for n, country in EXTRACT_COUNTRIES.items()]
    coded = F.exists(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), lambda p: F.upper(p).isin(*STATES))
    return F.coalesce(*named, F.when((F.size(parts) > 0) & coded, "United States"), F.lit("Unknown"))


def places(spark, sf_dir) -> DataFrame:
    """Every customer at a place: a town with a state, with a country, or remote in a country."""
    codes, names = list(STATES), sorted(COUNTRY_NAMES.values())
    k = F.col("c_custkey")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr("c_custkey div 4") % len(values)).cast("int") + 1)
    town = F.concat(F.lit("Town"), F.translate((k % 97).cast("string"), "0123456789", "abcdefghij"))
    state, country = at(codes), at(names)
    text = (
        F.when(k % 4 == 0, F.concat(town, F.lit(", "), state)).when(k % 4 == 1, F.concat(town, F.lit(", "), country)).when(k % 4 == 2, F.concat(F.lit("Remote - "), country))
        .otherwise(F.concat(town, F.lit(", "), state, F.lit("; Near "), town, F.lit(" County, "), state))
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.alias("location"))


_TABLES = (
    f"st(i, code) AS (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(STATES))}), co(i, code, name, region) AS (VALUES "
    + ", ".join(f"({i}, '{c}', '{n}', '{COUNTRY_REGIONS[c]}')" for i, (n, c) in enumerate(sorted((n, c) for c, n in COUNTRY_NAMES.items()))) + ")"
)
_WHERE = f"""{_TABLES}, w AS (SELECT c_custkey, c_custkey % 4 AS k, st.code AS state, co.code AS country, co.name AS country_name, co.region, 'Town' || translate(CAST(c_custkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') AS town
FROM customer JOIN st ON st.i = c_custkey // 4 % {len(STATES)} JOIN co ON co.i = c_custkey // 4 % {len(COUNTRY_NAMES)})"""


@query(f"WITH {_WHERE} SELECT c_custkey, CASE WHEN k IN (1, 2) THEN country ELSE 'US' END AS country, CASE WHEN k IN (1, 2) THEN region ELSE 'AMER' END AS region FROM w")
def ge_geo_of_places(spark, sf_dir) -> DataFrame:
    """Country and region of places in all states and countries."""
    found = per_distinct(places(spark, sf_dir), "location", "geo", infer_geo)
    return found.select("c_custkey", "geo.country", "geo.region")


@query(
    f"""WITH {_WHERE} SELECT c_custkey, k IN (0, 3) AND state IN ('WA', 'OR', 'TX') AS in_state, k IN (1, 2) AND (country = 'DE' OR country = 'JP') AS in_country, k IN (1, 2) AND region = 'APAC' AS in_region,
k = 3 AND state = 'WA' AS in_county, town = 'Townb' AND k <> 2 AND (k = 1 OR state = 'CA') AND (k <> 1 OR false) OR (town = 'Townab' AND k <> 2) AS in_town FROM w"""
)
def ge_place_filters(spark, sf_dir) -> DataFrame:
    """Filters on places, as users write them, over places in all states and countries."""
    rows = per_distinct(per_distinct(places(spark, sf_dir), "location", "entries", entries), "location", "geo", infer_geo)
    at = F.col("location"), F.col("entries"), F.col("geo")
    return rows.select(
        "c_custkey", in_place(*at, states=state_filters(["wa", "Oregon State", "Texas", "Bavaria"])).alias("in_state"),
        in_place(*at, countries=country_filters(["DE", "raw:Japan", "de"])).alias("in_country"), in_place(*at, regions=region_filters(["apac", "moon"])).alias("in_region"),
        in_place(*at, counties=county_filters(["WA|Near Town", "WA|near town county"]), states=["WA"]).alias("in_county"),
        in_town(F.col("entries"), city_filters(["Townb, CA", "Townb|CA", "Townab"])).alias("in_town"),
    )


_KNOWN = """('Canada', 'United Kingdom', 'Australia', 'New Zealand', 'Germany', 'France', 'Spain', 'Italy', 'Ireland', 'India', 'Singapore', 'Japan', 'Mexico', 'Brazil', 'Netherlands', 'Belgium', 'Sweden', 'Norway',
'Denmark', 'Finland', 'Switzerland', 'Poland', 'Austria', 'Portugal', 'South Africa', 'United States')"""


@query(f"""WITH {_WHERE} SELECT c_custkey, CASE WHEN k IN (1, 2) THEN CASE WHEN country_name IN {_KNOWN} THEN country_name WHEN country_name = 'Ukraine' THEN 'United Kingdom' ELSE 'Unknown' END
ELSE 'United States' END AS country FROM w""")
def ge_simple_country(spark, sf_dir) -> DataFrame:
    return per_distinct(places(spark, sf_dir), "location", "country", simple_country).select("c_custkey", "country")
