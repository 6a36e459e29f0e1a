"""Pay from descriptions: currency, bounds and period of the first passage that states an amount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.registry import query

# Currencies, words of lines about pay, an amount, the arms in the order in which they are tried, and periods.
CODES = "USD|CAD|AUD|EUR|GBP|JPY|NZD|CHF|SEK|NOK|DKK|INR"
SYMBOLS = {"€": "EUR", "£": "GBP", "¥": "JPY", "$": "USD"}
PAY_WORDS = r"(?i)\$|€|£|¥|usd|cad|aud|eur|gbp|jpy|salary|compensation|pay|wage|hourly|annual|per\s+hour|per\s+year"
MONEY = rf"((?:{CODES})?\s*[$€£¥]?\s*(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d{{1,2}})?\s*[kKmM]?)"
ARMS = {
    "range": rf"(?i){MONEY}\s*(?:-|–|—|to)\s*{MONEY}",
    "max": rf"(?i)(?:up\s*to|max(?:imum)?\s*(?:of)?|no\s*more\s*than)\s*{MONEY}",
    "min": rf"(?i)(?:from|starting\s*at|minimum\s*(?:of)?|at\s*least)\s*{MONEY}",
    "exact": rf"(?i)\b(?:pay|salary|compensation|wage|rate)\b\s*(?:range)?\s*[:\-]?\s*{MONEY}(?!\s*(?:-|–|—|to))",
}
PERIODS = {
    "hour": r"(?i)per\s*hour|an?\s*hour|hourly|/\s*hr|/\s*hour", "week": r"(?i)per\s*week|weekly|/\s*wk|/\s*week", "month": r"(?i)per\s*month|monthly|/\s*mo|/\s*month",
    "year": r"(?i)per\s*year|annually|annual|yearly|/\s*yr|/\s*year",
}
RETIREMENT = r"(?i)\b401\s*(?:\(\s*k\s*\)|k\b)"
_PLAIN = (
    (r"(?i)</(?:p|div|li|h[1-6]|ul|ol)>|<br\s*/?>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("&#39;", "'"), ("(?i)&amp;", "&"), ("\r", ""), (r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]{2,}", " "),
)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def currency(text: Column) -> Column:
    """Code that a text names, else that of its symbol."""
    code = F.upper(F.regexp_extract(text, rf"(?i)\b({CODES})\b", 1))
    return F.coalesce(F.when(code != "", code), *[F.when(text.contains(s), c) for s, c in SYMBOLS.items()])


def period(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in PERIODS.items()])


def amount(token: Column) -> Column:
    """Number of an amount, thousands and millions told; null for none or zero."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(token, rf"(?i)\b(?:{CODES})\b", ""), r"[$€£¥\s,]", ""))
    number = F.regexp_replace(bare, "[km]$", "").try_cast("double")
    value = F.when(bare.endswith("k"), F.round(number * 1000)).when(bare.endswith("m"), F.round(number * 1_000_000)).otherwise(number)
    return F.when(value > 0, value)


def _sound(token: Column, passage: Column, told: Column, per: Column) -> Column:
    """The amount of a token if a currency, a period or its own size makes it pay and it is no retirement plan."""
    value = amount(token)
    plan = token.rlike(RETIREMENT) | (F.coalesce(value == 401, F.lit(False)) & passage.rlike(RETIREMENT))
    scale = token.rlike(r"[kKmM]\b|\d{1,3}(?:,\d{3})+") | F.coalesce(value >= 1000, F.lit(False))
    return F.when(~plan & (told.isNotNull() | per.isNotNull() | scale), value)


def _stated(passage: Column) -> Column:
    """What the first arm that fits states; null if none does."""

    def arm(name: str, pattern: str) -> Column:
        raw = F.regexp_extract(passage, pattern, 0)
        told, per = currency(raw), period(passage)
        of = lambda group: _sound(F.regexp_extract(passage, pattern, group), passage, told, per)
        nothing = F.lit(None).cast("double")
        bounds = {"range": lambda: (of(1), of(2)), "max": lambda: (nothing, of(1)), "min": lambda: (of(1), nothing), "exact": lambda: (of(1), of(1))}[name]()
        both = F.struct(*(b.alias(n) for b, n in zip(bounds, "ab", strict=True)))
        swapped = lambda b: b["a"] > b["b"]
        return _let(
            both,
            lambda b: F.when(
                (raw != "") & (b["a"].isNotNull() | b["b"].isNotNull()),
                F.struct(
                    F.when(swapped(b), b["b"]).otherwise(b["a"]).alias("pay_min"), F.when(swapped(b), b["a"]).otherwise(b["b"]).alias("pay_max"),
                    told.alias("pay_currency"), per.alias("pay_period"), F.trim(raw).alias("pay_raw"),
                ),
            ),
        )

    return F.coalesce(*[arm(n, p) for n, p in ARMS.items()])


def pay_from_description(html: Column) -> Column:
    """Struct of pay_min, pay_max, pay_currency, pay_period and pay_raw of the first line about pay that states it, else of the whole text; null if nothing does."""
    text = F.trim(reduce(lambda c, r: F.regexp_replace(c, *r), _PLAIN, F.coalesce(html, F.lit(""))))

    def read(plain: Column) -> Column:
        lines = F.filter(F.transform(F.split(plain, "\n+"), lambda x: F.trim(x)), lambda x: x.rlike(PAY_WORDS))
        return F.get(F.filter(F.transform(F.concat(lines, F.array(plain)), _stated), lambda s: s.isNotNull()), F.lit(0))

    return _let(text, read)


#: Sentences of each document in SQL; a, b and h are numbers of its own.
_SAID = """CASE doc_id % 14 WHEN 0 THEN '<p>Salary: $' || a || ',000 - $' || b || ',000 per year</p><p>Apply</p>' WHEN 1 THEN 'Pay range: ' || h || ' to ' || (h + 4) || ' an hour' WHEN 2 THEN 'Compensation up to €' || a || 'k annually'
WHEN 3 THEN 'Join us.<br/>Hourly, starting at £' || h || '.50' WHEN 4 THEN 'Wage: ' || h || ' per hour' WHEN 5 THEN 'Our 401(k) plan and pay: 401' WHEN 6 THEN 'USD ' || b || ',000 to ' || a || ',000 compensation' WHEN 7 THEN 'We offer ' || h || ' weeks off'
WHEN 8 THEN '<b>Salary</b> 1.5M yearly' WHEN 9 THEN 'We pay in $' || chr(10) || 'at least CAD ' || a || ',250' WHEN 10 THEN 'Rate: ' || h WHEN 11 THEN '<li>Base salary&nbsp;$' || a || 'K – $' || b || 'K</li>'
WHEN 12 THEN 'No more than ' || a || '000 a year' ELSE 'Teams of 2 - 3 people' || chr(10) || 'weekly wage: ¥' || b || ',000.75' END"""
_OWN = "doc_id, 40 + doc_id // 14 % 50 AS a, 46 + doc_id // 14 % 50 + doc_id // 14 % 7 AS b, 15 + doc_id // 14 % 30 AS h"


@query(
    f"""WITH d AS (SELECT doc_id % 14 AS k, {_OWN} FROM documents)
SELECT doc_id, (CASE WHEN k IN (0, 6, 11) THEN a * 1000 WHEN k IN (1, 4) THEN h WHEN k = 3 THEN h + 0.5 WHEN k = 8 THEN 1500000 WHEN k = 9 THEN a * 1000 + 250 WHEN k = 13 THEN b * 1000 + 0.75 END)::DOUBLE AS pay_min,
(CASE WHEN k IN (0, 6, 11) THEN b * 1000 WHEN k = 1 THEN h + 4 WHEN k = 4 THEN h WHEN k IN (2, 12) THEN a * 1000 WHEN k = 8 THEN 1500000 WHEN k = 13 THEN b * 1000 + 0.75 END)::DOUBLE AS pay_max,
CASE WHEN k IN (0, 6, 11) THEN 'USD' WHEN k = 2 THEN 'EUR' WHEN k = 3 THEN 'GBP' WHEN k = 9 THEN 'CAD' WHEN k = 13 THEN 'JPY' END AS pay_currency,
CASE WHEN k IN (0, 2, 8) THEN 'year' WHEN k IN (1, 3, 4) THEN 'hour' WHEN k = 13 THEN 'week' END AS pay_period,
CASE k WHEN 0 THEN '$' || a || ',000 - $' || b || ',000' WHEN 1 THEN h || ' to ' || (h + 4) WHEN 2 THEN 'up to €' || a || 'k' WHEN 3 THEN 'starting at £' || h || '.50' WHEN 4 THEN 'Wage: ' || h WHEN 6 THEN 'USD ' || b || ',000 to ' || a || ',000'
WHEN 8 THEN 'Salary 1.5M' WHEN 9 THEN 'at least CAD ' || a || ',250' WHEN 11 THEN '$' || a || 'K – $' || b || 'K' WHEN 12 THEN 'No more than ' || a || '000' WHEN 13 THEN 'wage: ¥' || b || ',000.75' END AS pay_raw FROM d"""
)
def tx_pay_from_description(spark, sf_dir) -> DataFrame:
    """Pay that fourteen kinds of sentences state, with each document's own numbers; three state none."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[x.strip().replace("//", "div") for x in _OWN.split(",")]).selectExpr("doc_id", f"{_SAID} AS said")
    return rows.select("doc_id", pay_from_description(F.col("said")).alias("p")).select("doc_id", "p.*")
