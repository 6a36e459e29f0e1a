"""Function tables on small inputs."""

import pytest
from pyspark.sql import functions as F

from boardlake.functions import dates, fields, geo, hiring, industry, text
from boardlake.operators import similar
from boardlake.streaming import streams

NOW = 1_706_659_200


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    given = {
        "yesterday": NOW - 86400, "3 days ago": NOW - 3 * 86400, "30d": NOW - 30 * 86400, "5 hours ago": NOW - 18000, "about 3 months": NOW - 90 * 86400, "almost 2 years": NOW - 18 * 365 * 8640,
        "over 1 week": NOW - 725_760, "19 minutes": NOW - 1140, "2024-01-02": 1704153600, "Posted January 2nd, 2024": 1704153600, "Jan 2 2024": 1704153600, "2 January 2024": 1704153600,
        "1/2/2024": 1704153600, "2024-01-02T00:00:00.000Z": 1704153600, "2024-01-02T02:00:00+02:00": 1704153600, "1700000000": 1700000000, "1700000000123": 1700000000, "Just now": NOW, "posted today": NOW,
        "January 2": 1704153600, "Dec 31": 1703980800, "Feb 1": NOW + 86400, "n/a": None, "": None, "May 5, 2023": 1683244800,
    }
    assert dict(zip(given, values(spark, lambda c: dates.posting_epoch(c, NOW), list(given)), strict=True)) == given
    assert values(spark, lambda c: dates.posting_epoch(c, NOW), [None]) == [None]


def test_written_dates(spark):
    ten = 1_704_448_800  # 2024-01-05 10:00 UTC
    given = {
        "2024-01-05T10:00:00": ten, "2024-01-05T10:00:00+0000": ten, "2024-01-05T10:00:00.123456Z": ten, "2024-01-05 10:00": ten, "2023/11/05": 1_699_142_400, "01/05/24": ten - 36_000, "Sept 5, 2023": 1_693_872_000,
        "Fri, 05 Jan 2024 10:00:00 GMT": ten, "Friday January 5th, 2024 at 10:00 AM": ten, "5-Jan-2024": ten - 36_000, "Jan 5 2024 05:00 EST": ten, "2024-01-05T12:00:00+02:00": ten, "January 2024": 1_704_067_200,
        "2024-01": 1_704_067_200, "1/5/50": -631_152_000 + 4 * 86_400, "31/31/2024": None, "Mayor 5, 2024": None, "2024-01-05T25:00:00": None, "5 apples 2024": None, "Posted": None, "12:30": None,
    }
    assert dict(zip(given, values(spark, lambda c: dates.posting_epoch(c, NOW), list(given)), strict=True)) == given


def test_dates_are_trusted_by_what_they_say(spark):
    got = values(spark, lambda c: dates.trusted_date(c, NOW), ["", None, "Source date unavailable", "soon", "2024-03-01", "2024-01-31"])
    assert [tuple(g) for g in got] == [(None, "missing")] * 3 + [(None, "uncertain")] * 2 + [(NOW, "confirmed")]
    assert values(spark, lambda c: dates.within_window(c, NOW, 24, strict=True), ["", None, "today"]) == [False, False, True]


def test_window_keeps_blank_and_drops_unreadable(spark):
    assert values(spark, lambda c: dates.within_window(c, NOW, 24), ["", None, "n/a", "yesterday", "2 days ago"]) == [True, True, False, True, False]


@pytest.mark.parametrize(
    ("place", "want"),
    [
        ("Kent, WA", [("Kent", "WA", "US")]), ("Shepherdsville, Kentucky", [("Shepherdsville", "KY", "US")]), ("Florence Kentucky", [("Florence", "KY", "US")]),
        ("Bellevue, South Africa", [("Bellevue", None, "ZA")]), ("Perth, WA, Australia", [("Perth", None, "AU")]), ("US-WA-Redmond", [("Redmond", "WA", "US")]),
        ("Winston-Salem, NC", [("Winston-Salem", "NC", "US")]), ("Washington, DC, United States", [("Washington", "DC", "US")]),
        ("Cambridge, Massachusetts 02139, United States of America", [("Cambridge", "MA", "US")]), ("", []), (None, []),
        ("Seattle, WA, Austin, TX", [("Seattle", "WA", "US"), ("Austin", "TX", "US")]), ("Charleston West Virginia", [("Charleston", "WV", "US")]),
        ("Albuquerque New Mexico", [("Albuquerque", "NM", "US")]), ("Georgetown District of Columbia", [("Georgetown", "DC", "US")]), ("Portland, Washington, DC", [("Washington", "DC", "US")]),
        ("New York, NY", [(None, "NY", "US")]), ("Mumbai Remote", [("Mumbai", None, None)]), ("Ontario", [("Ontario", None, None)]), ("Toronto, ON M5V 2T6, Canada", [("Toronto", None, "CA")]),
        ("Multiple Locations", []), ("Texas", [(None, "TX", "US")]), ("Denver, CO / Remote (Boise, ID)", [("Denver", "CO", "US"), ("Boise", "ID", "US")]),
    ],
)
def test_places(spark, place, want):
    df = spark.createDataFrame([(place,)], "x string").select(geo.entries(F.col("x")).alias("e"))
    assert [tuple(e) for e in df.first().e] == want


def test_text_forms(spark):
    assert values(spark, text.like_text, ["  A  b\tC ", None]) == ["a b c", None]
    assert values(spark, text.geo_text, ["São Paulo & Côte-d'Or", "Łódź Šiauliai Ắn"]) == ["sao paulo and cote dor", "odz siauliai an"]
    assert values(spark, text.clean_html, ["<p>a&nbsp;&lt;b</p>\n<br>c&#39;d"]) == ["a <b c'd"]
    assert values(spark, text.title_words, ["The Senior C/C++ Engineer and Engineer 2024"]) == [["senior", "engineer"]]
    assert values(spark, text.company_from_url, ["https://www.acme-co.example.com/x", "http://jobs.big_one.com"]) == ["acme co", "big one"]


def test_entities_and_page_text(spark):
    from boardlake.functions import enrich

    assert values(spark, enrich.decode_entities, ["a &#233;&#x4E2D;&lt;b&gt; &#0; &amp;", "", None, "&#128512;&#xD800;"]) == ["a é中<b> &#0; &", "", None, "\N{GRINNING FACE}&#xD800;"]
    assert values(spark, enrich.html_to_text, ["<script>x</script><ul><li>one</li><li>two&nbsp;x</li></ul><!-- c -->end", None]) == ["- one\n\n- two x\nend", None]


def test_pay_from_prose(spark):
    from boardlake.functions import enrich

    got = values(spark, enrich.pay_from_prose, ["$136,000 - $200,000 per year", "$105,000 to $110,000 annually", "pay $28.50 per hour", "between $95k and $120k", "7 to 10 years of cases", "Shift runs 8 - 10 daily.", "", None])
    assert [r and (r.pay_min, r.pay_max, r.pay_period) for r in got] == [
        (136000.0, 200000.0, "year"), (105000.0, 110000.0, "year"), (28.5, 28.5, "hour"), (95000.0, 120000.0, "year"), None, None, None, None,
    ]


def test_sections(spark):
    from boardlake.functions import enrich

    many = "Requirements\n" + "\n".join(f"- demand number {i} of a long list" for i in range(20))
    got = values(spark, enrich.sections, [many, "no heads at all", "", None, "About the role\nYou lead the whole crew here.\nBenefits\n- not a duty of any kind at all"])
    assert [len(r.requirements) for r in got] == [12, 0, 0, 0, 0]
    assert got[4].responsibilities == ["You lead the whole crew here."]


def test_pages_without_a_posting_give_none(spark):
    from boardlake.sources import pages

    block = '<script type="application/ld+json">{}</script>'
    got = values(spark, pages.jsonld_posting, [block.format("not json"), block.format('{"@type": "Organization"}'), "", None, block.format('[{"@type": ["Thing", "JobPosting"], "title": "x"}]')])
    assert [g is not None for g in got] == [False, False, False, False, True]
    assert values(spark, lambda c: F.size(pages.site_entries(c)), ["<urlset><url><loc>a</loc></url><url></url></urlset>", "no xml"]) == [1, 0]


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Salesforce Developer", "information_technology_software"), ("Salesforce Account Executive", "information_technology_software"),
        ("Regional Sales Lead", "sales_business_development"), ("Pre sale clerk", None), ("Payroll Analyst II", "finance_accounting_banking_insurance"),
        ("RN", "healthcare_medical"), ("Warner", None), ("Data Engineer", "data_ai_analytics"), (None, None), ("", None),
    ],
)
def test_industry_rules(spark, title, want):
    found = spark.createDataFrame([(title,)], "x string").select(industry.rule(F.col("x")).alias("r")).first().r
    assert (found and found.industry) == want


def test_grams_of_short_titles(spark):
    assert values(spark, lambda c: industry.grams(industry.title_parts(c)), ["", None, "Lead", "Red Hat Lead"]) == [
        [""][:0], [], ["lead"], ["red", "hat", "lead", "red hat", "hat lead", "red hat lead"]
    ]


def test_fields(spark):
    assert values(spark, fields.json_list, ['["a", " b ", ""]', "[broken", None, "{}"]) == [["a", "b"], [], [], []]
    assert values(spark, fields.csv_list, [" a,, b ", "", None]) == [["a", "b"], [], []]
    assert values(spark, fields.base64_text, ["aGVsbG8=", "!!", None]) == ["hello", "", ""]
    assert values(spark, fields.pay_number, ["$1,200.50", "-3", "x", None]) == [1200.5, None, None, None]
    assert values(spark, fields.bool_flag, ["YES", " 0", "?", None]) == [True, False, False, False]
    assert values(spark, fields.currency, [" usd", "xyz", None]) == ["USD", None, None]
    assert values(spark, fields.compensation_type, ["wage", "Per-Year", "?", None]) == ["hourly", "salary", "unknown", "unknown"]
    assert values(spark, fields.normalize_url, ["a.example.com/x", "HTTP://a.b/c", "ftp://a.b", "", None]) == ["https://a.example.com/x", "HTTP://a.b/c", None, None, None]
    assert values(spark, lambda c: fields.days_in_window(c, 3), ["Posted 3 Days Ago", "4 days ago", "Posted 30+ Days Ago", "Posted Today", "", None]) == [
        True, False, False, True, False, False
    ]


def test_hiring_clauses_open_whole_states(spark):
    told = "We are hiring out of Arizona, Denver, and Seattle."
    df = spark.createDataFrame([("Phoenix, AZ", told), ("Boise, ID", told), ("Seattle, WA", told), ("Boise, ID", ""), (None, told)], "head string, body string")
    got = df.select(hiring.conflict(geo.entries(F.col("head")), hiring.hiring_places(F.col("body"))).alias("c")).collect()
    assert [r.c for r in got] == [False, True, False, False, False]


def test_country_and_region(spark):
    got = values(spark, hiring.infer_geo, ["Paris, France", "Boise, ID", "Remote, EMEA", "", None, "Albuquerque New Mexico", "Puebla, Mexico"])
    assert [tuple(g) for g in got] == [("FR", "EMEA"), ("US", "AMER"), (None, "EMEA"), (None, None), (None, None), ("US", "AMER"), ("MX", "AMER")]


def test_country_of_the_extract(spark):
    from boardlake.functions import places

    given = {"Malibu, CA": "United States", "Roman Forest, TX": "United States", "Peru, IN": "United States", "Lima, Peru": "Unknown", "Köln, Germany": "Germany", "London UK": "United Kingdom", "": "Unknown"}
    assert dict(zip(given, values(spark, places.simple_country, list(given)), strict=True)) == given


def test_sources(spark):
    from boardlake.functions import sources

    urls = {
        "https://acme.wd5.myworkdayjobs.com/x/job/y": "workday", "https://JOBS.lever.co/acme/1": "lever", "https://acme.applytojob.com": "applytojob", "https://acme.example.com/careers/jobdetail/x": "avature",
        "https://www.policeapp.com/x/123/": "policeapp", "https://www.policeapp.com/about": None, "https://jobs.example.com": None, "": None, "https://x.recruitee.com/o/a": "recruitee",
    }
    assert dict(zip(urls, values(spark, sources.infer_source, list(urls)), strict=True)) == urls
    assert values(spark, sources.source_key, ["AshbyHQ", "lever.co", "greenhouse.io", "taleo.net", "hire.trakstar.com", "occupop-careers.com", "Odd Board", None]) == [
        "ashby", "lever", "greenhouse", "taleo", "trakstar", "occupop", "odd board", None
    ]


def test_filters_on_places_are_read():
    from boardlake.functions import places

    assert places.state_filters(["wa", "Washington State", "Bavaria", "new york"]) == ["WA", "NY"]
    assert places.country_filters(["us", "RAW:nederland", "Atlantis", "raw:x", "Japan", "JP"]) == ["US", "NL", "RAW:atlantis", "JP"]
    assert places.region_filters(["emea", "EMEA", "north"]) == ["EMEA"]
    assert places.county_filters(["WA|King County", "Orleans Parish", "|", " "]) == [("WA", "king"), ("", "orleans")]
    assert places.city_filters(["Kent, WA", "Kent|WA", "Kent", "Paris, France", "São Paulo", ""]) == [
        places.Town("kent", "WA"), places.Town("kent"), places.Town("paris", "", "FR"), places.Town("sao paulo")
    ]


def test_blank_places_fail_any_filter(spark):
    from boardlake.functions import places

    df = spark.createDataFrame([("Kent, WA",), ("Kent, England",), ("",), (None,)], "x string")
    x = F.col("x")
    got = df.select(
        places.in_place(x, geo.entries(x), hiring.infer_geo(x), states=["WA"]).alias("a"), places.in_place(x, geo.entries(x), hiring.infer_geo(x), countries=["GB"]).alias("b"),
        places.in_place(x, geo.entries(x), hiring.infer_geo(x)).alias("c"), places.in_town(geo.entries(x), places.city_filters(["Kent, WA"])).alias("d"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True), (False, True, True, False), (False, False, True, False), (False, False, True, False)]


def test_pages_tell_what_became_of_a_posting(spark):
    from boardlake.sources import inspection

    long = "word " * 60
    rows = [
        (1, 404, None), (2, 503, "x"), (3, None, None), (4, 200, f"<body><nav>menu</nav><p>{long}</p>The position is no longer available</body>"), (5, 200, "<body>x</body>"),
        (6, 200, f'<main>{long} sign in to apply</main><footer>position has been filled</footer>'), (7, 200, ""),
    ]
    found = {r.posting_id: r for r in inspection.inspect_pages(spark.createDataFrame(rows, "posting_id int, http_status int, html string")).collect()}
    assert [(found[i].ok, found[i].dead, found[i].unverified) for i in range(1, 8)] == [
        (True, True, False), (False, False, False), (False, False, False), (True, True, False), (True, False, True), (True, False, False), (True, False, True)
    ]
    assert found[6].requires_account and "footer" not in found[6].description and found[4].description is None
    assert values(spark, lambda c: inspection.signals(c)["compensation_type"], ["$20 / hr", "annual pay", "hourly or yearly", "", None]) == ["hourly", "salary", "both", "unknown", "unknown"]


def test_brief_agrees_with_its_parts(spark):
    from boardlake.operators import matching, upkeep

    body = "Requirements\n- Forklift license and steady hands at work\n- Deep knowledge of tax law in Norway\n"
    resume = "Forklift license holder with steady hands and years in the yard\nshort"
    rows = {r.posting_id: r for r in upkeep.brief(spark.createDataFrame([(1, body), (2, ""), (3, None)], "posting_id int, job_description string"), resume).collect()}
    assert [rows[i].available for i in (1, 2, 3)] == [True, False, False]
    assert rows[1].unmatched_requirements == ["Deep knowledge of tax law in Norway"] and rows[1].resume_evidence == [resume.split("\n")[0]]
    assert set(rows[1].overlap_terms) == {"forklift", "license", "steady", "hands"} and len(rows[1].requirements) == 2
    assert values(spark, matching.words, ["the forklift and experience"]) == [["forklift", "experience"]] and values(spark, text.tokens, ["the forklift and experience"]) == [["forklift"]]


def test_a_listing_asks_for_known_queues():
    from boardlake.operators import joins, listing

    with pytest.raises(ValueError, match="review_queue"):
        listing.Spec(review_queue="old")
    with pytest.raises(ValueError, match="column"):
        joins.top_k("text")
    saved = {"search": "red", "states": ["WA"], "pay_min": 5, "remote": ["remote"]}
    assert listing.candidates({"states": ["OR"], "limit": 0}, saved, budget=7) == listing.Spec(search="red", states=["OR"], remote=["remote"], include_applied=False, limit=7)
    assert listing.candidates({"include_applied": True}, saved, use_settings=False) == listing.Spec(include_applied=True, limit=10)
    assert listing.Spec(limit=9000, offset=-3).limit == 2000 and listing.Spec(offset=-3).offset == 0


def test_sql_functions_equal_expressions(spark):
    fields.register(spark)
    df = spark.createDataFrame([(" Hybrid -  Boston ",), ("the Red-Widget 12 and cog",), ("",)], "x string")
    from boardlake.functions import sources

    links = [f"https://{b}1" for b in sources.BOARDS]
    told = spark.createDataFrame([(x,) for x in links], "x string").select(F.expr("infer_source(x)").alias("a"), sources.infer_source(F.col("x")).alias("b")).collect()
    assert all(r.a == r.b for r in told) and len({r.a for r in told}) > 50
    for row in df.selectExpr("like_text(x) a", "work_mode(x) b", "title_words(x) c", "x").withColumns(
        {"d": text.like_text(F.col("x")), "e": geo.work_mode(F.col("x")), "f": text.title_words(F.col("x"))}
    ).collect():
        assert (row.a, row.b, row.c) == (row.d, row.e, row.f)


def test_evidence_prefers_more_terms_then_earlier_lines(spark):
    lines = ["short token line", "one token in a line that is long enough to count", "token and license in a line that is long enough too", "another token line that is surely long enough for it"]
    got = values(spark, lambda c: similar.evidence(c, ["token", "license"]), ["\n".join(lines), None])
    assert [(e.n, e.place) for e in got[0]] == [(2, 1), (1, 0), (1, 2)] and got[1] == []


def test_stream_merges_files_in_turn(spark, tmp_path):
    schema = "job_posting_url string, position_name string, location string, job_description string, pay_min double, pay_max double, batch_order bigint"
    for i, rows in enumerate([[("u", "old", "a", None, None, None, 1), ("v", "kept", None, None, None, None, 2)], [("u", "new", None, None, None, None, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.upsert_stream(source, str(tmp_path / "out"), 9).orderBy("job_posting_url").collect()
    assert [(r.position_name, r.location, r.last_seen_epoch) for r in got] == [("new", "a", 9), ("kept", None, 9)]


def test_pay_of_descriptions(spark):
    from boardlake.functions import pay

    given = {
        "": None, "no numbers, good pay": None, "401(k) match and salary": None, "Rate: 12": None, "Pay: $12": (12.0, 12.0, "USD", None, "Pay: $12"), "Salary: 70k": (70_000.0, 70_000.0, None, None, "Salary: 70k"),
        "From 5 to 9, up to $90,000 per year": (5.0, 9.0, None, "year", "5 to 9"), "Compensation<br>&nbsp;minimum of EUR 40,000": (40_000.0, None, "EUR", None, "minimum of EUR 40,000"),
        "<p>Ages 18 - 65</p><p>Salary 50,000 to 40,000 per month</p>": (40_000.0, 50_000.0, None, "month", "50,000 to 40,000"), "wage: 0 per hour": None,
    }
    found = dict(zip(given, values(spark, pay.pay_from_description, list(given)), strict=True))
    assert {k: tuple(v) if v else v for k, v in found.items()} == given
    assert values(spark, pay.pay_from_description, [None]) == [None]
