"""Where a text says it hires, against the places in a posting's head; countries and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.constants import COUNTRIES, COUNTRY_REGIONS, STATES
from boardlake.functions.enrich import with_line
from boardlake.functions.geo import _map, entries, located, per_distinct
from boardlake.functions.text import geo_text
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

# Clauses that name where someone must live; the places follow.
CLAUSES = (
    r"(?i)(?:hiring|hire)(?: candidates)?(?: only)? (?:out of|in|from)[:\s]+([^.;\n!?]{3,300})",
    r"(?i)this (?:role|position|job) (?:is|will be) based (?:out of|in)[:\s]+([^.;\n!?]{3,300})",
    r"(?i)must (?:be located|be based|reside|live|currently reside) (?:in|near|within)[:\s]+([^.;\n!?]{3,300})",
    r"(?i)candidates? must be (?:located|based) (?:in|near)[:\s]+([^.;\n!?]{3,300})",
    r"(?i)open (?:only )?to candidates (?:located |based )?in[:\s]+([^.;\n!?]{3,300})",
)
# Words that name a region, and the region of each country known.
REGION_HINTS = {
    "AMER": ("amer", "americas", "north america", "south america", "latin america", "latam", "caribbean"),
    "EMEA": ("emea", "europe", "middle east", "africa"),
    "APAC": ("apac", "asia pacific", "asia", "oceania"),
}
def hiring_places(text: Column) -> Column:
    """Distinct (city, state, country) of all clauses. A state's name alone is the whole state."""
    names = _map({v.lower(): k for k, v in STATES.items()})
    said = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in CLAUSES])
    places = F.filter(
        F.transform(F.split(F.array_join(F.transform(said, lambda s: F.regexp_replace(s, r"(?i)\b(?:or|and)\b", ",")), ","), ","), lambda x: F.trim(x)), lambda p: p != ""
    )
    whole = F.filter(places, lambda p: names[F.lower(p)].isNotNull())
    states = F.transform(
        whole, lambda p: F.struct(F.lit(None).cast("string").alias("city"), names[F.lower(p)].alias("state"), F.lit("US").alias("country"))
    )
    rest = entries(F.array_join(F.filter(places, lambda p: names[F.lower(p)].isNull()), ";"))
    return F.array_distinct(F.concat(rest, states))


def conflict(head: Column, hiring: Column) -> Column:
    """Whether a city of the head is neither named nor in a state that is open as a whole."""
    cities = F.transform(F.filter(hiring, lambda e: e["city"].isNotNull()), lambda e: geo_text(e["city"]))
    states = F.transform(F.filter(hiring, lambda e: e["city"].isNull() & e["state"].isNotNull()), lambda e: e["state"])
    outside = lambda e: (
        e["city"].isNotNull() & ~F.array_contains(cities, geo_text(e["city"])) & ~F.coalesce(F.array_contains(states, e["state"]), F.lit(False))
    )
    return F.coalesce((F.size(cities) + F.size(states) > 0) & F.exists(head, outside), F.lit(False))


def region(text: Column, country: Column) -> Column:
    """Region that the text names as words, else the country's."""
    words = F.concat(F.lit(" "), geo_text(F.coalesce(text, F.lit(""))), F.lit(" "))
    named = [F.when(words.rlike(f" ({'|'.join(hints)}) "), name) for name, hints in REGION_HINTS.items()]
    return F.coalesce(*named, _map(COUNTRY_REGIONS)[country])


def infer_geo(text: Column) -> Column:
    """Struct of country and region: the last segment that is a country or a state by name, else the US where a state stands."""
    parts = F.reverse(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,/|;]|-\s"), lambda p: geo_text(p)))
    names = _map(COUNTRIES | {n.lower(): "US" for n in STATES.values()})  # so that New Mexico isn't Mexico

    def code(part: Column) -> Column:
        """The segment, or else its last four, three, two words or word, as a country."""
        words = F.split(part, " ")
        return F.coalesce(names[part], *[names[F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")] for n in (4, 3, 2, 1)])

    told = F.try_element_at(F.filter(F.transform(parts, code), lambda c: c.isNotNull()), F.lit(1))
    state = F.exists(entries(text), lambda e: e["country"] == "US")
    country = F.coalesce(told, F.when(state, "US"))
    return F.struct(country.alias("country"), region(text, country).alias("region"))


def entry_matches(found: Column, terms: list[str] = (), states: list[str] = (), countries: list[str] = ()) -> Column:
    """One and the same entry meets all kinds of wishes that are given, and any of each kind."""
    def meets(e: Column) -> Column:
        ok = F.lit(True)
        if terms:
            city = F.concat(F.lit(" "), geo_text(F.coalesce(e["city"], F.lit(""))), F.lit(" "))
            ok = ok & city.rlike(" (" + "|".join(terms) + ") ")
        for wish, field in ((states, "state"), (countries, "country")):
            if wish:
                ok = ok & F.coalesce(e[field].isin(*wish), F.lit(False))
        return ok

    return F.coalesce(F.exists(found, meets), F.lit(False))


_LINES = [
    "We are hiring out of Arizona, Seattle, Denver, and Austin.", "Candidates must be located in Washington, DC.", "This role is based in Boston, MA or Kent",
    "We hire with care.",
]


@query(
    f"""WITH {POSTINGS}, h(r, places) AS (VALUES (0, 'Austin||,Denver||,Seattle||,|AZ|US'), (1, '|DC|US,|WA|US'), (2, 'Boston||,Kent||,|MA|US'), (3, '')),
c(location, cities, states) AS (VALUES ('Seattle, WA', ['Seattle'], ['WA']), ('Kent, WA', ['Kent'], ['WA']), ('Perth, WA, Australia', ['Perth'], ['']), ('US-WA-Redmond', ['Redmond'], ['WA']),
('Washington, DC', ['Washington'], ['DC']), ('Denver, CO; Austin, TX', ['Denver', 'Austin'], ['CO', 'TX']), ('Berlin, Germany', ['Berlin'], ['']), ('Hybrid - Boston, MA', ['Boston'], ['MA']),
('London, United Kingdom', ['London'], ['']), ('Portland, OR 97201', ['Portland'], ['OR']), ('Mumbai, India', ['Mumbai'], ['']), ('Chicago, IL or Remote', ['Chicago'], ['IL']), ('Florence Kentucky', ['Florence'], ['KY'])),
o(r, cities, states) AS (VALUES (0, ['Austin', 'Denver', 'Seattle'], ['AZ']), (1, [], ['DC', 'WA']), (2, ['Boston', 'Kent'], ['MA']))
SELECT posting_id, places, coalesce((SELECT bool_or(NOT list_contains(o.cities, x.city) AND NOT list_contains(o.states, x.state)) FROM (SELECT unnest(c.cities) AS city, unnest(c.states) AS state) x), false) AND o.r IS NOT NULL AS conflict
FROM postings JOIN h ON posting_id % 4 = h.r LEFT JOIN c USING (location) LEFT JOIN o ON posting_id % 4 = o.r"""
)
def tx_hiring_locations(spark, sf_dir) -> DataFrame:
    found = with_line(located(spark, sf_dir), _LINES).withColumn("h", hiring_places(F.col("job_description")))
    text = F.transform("h", lambda e: F.concat_ws("|", *[F.coalesce(e[f], F.lit("")) for f in ("city", "state", "country")]))
    return found.select("posting_id", F.array_join(F.array_sort(text), ",").alias("places"), conflict(F.col("entries"), F.col("h")).alias("conflict"))


@query(
    f"""WITH {POSTINGS}, a(location, country, region) AS (VALUES ('Perth, WA, Australia', 'AU', 'APAC'), ('Berlin, Germany', 'DE', 'EMEA'), ('London, United Kingdom', 'GB', 'EMEA'),
('Mumbai, India', 'IN', 'APAC'), ('', NULL, NULL), ('Seattle, WA', 'US', 'AMER'), ('Kent, WA', 'US', 'AMER'), ('US-WA-Redmond', 'US', 'AMER'), ('Washington, DC', 'US', 'AMER'),
('Remote - USA', 'US', 'AMER'), ('Denver, CO; Austin, TX', 'US', 'AMER'), ('Hybrid - Boston, MA', 'US', 'AMER'), ('Portland, OR 97201', 'US', 'AMER'), ('Chicago, IL or Remote', 'US', 'AMER'), ('Florence Kentucky', 'US', 'AMER'))
SELECT country, region, count(*) AS n FROM postings LEFT JOIN a USING (location) GROUP BY 1, 2"""
)
def ge_infer_country(spark, sf_dir) -> DataFrame:
    found = per_distinct(postings(spark, sf_dir), "location", "geo", infer_geo)
    return found.groupBy("geo.country", "geo.region").agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT posting_id, location FROM postings WHERE location IN ('Kent, WA', 'Seattle, WA', 'Denver, CO; Austin, TX')")
def ge_entry_filter(spark, sf_dir) -> DataFrame:
    return located(spark, sf_dir).filter(entry_matches(F.col("entries"), ["kent", "seattle", "austin"], ["WA", "TX"], ["US"])).select("posting_id", "location")
