"""Text of pages and facts read from prose: pay, sections, account walls. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

# Markup that is no text, and markup that ends a line.
_BLOCKS = r"(?is)<(?:script|style|noscript|svg)\b.*?</(?:script|style|noscript|svg)>|<!--.*?-->"
_BREAKS = r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>"


def decode_entities(c: Column) -> Column:
    """Named entities of the five marks and decimal or hexadecimal numbers of characters as text."""
    parts = F.split(c, r"(?=&#)")

    def number(p: Column) -> Column:
        decimal, hexa = F.regexp_extract(p, r"^&#([0-9]{1,7});", 1), F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.coalesce(F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("int"), F.nullif(decimal, F.lit("")).try_cast("int"))
        mark = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.concat(mark, F.regexp_replace(p, r"^&#[xX]?[0-9a-fA-F]+;", ""))).otherwise(p)

    c = F.array_join(F.transform(parts, number), "")
    for name, mark in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def html_to_text(c: Column) -> Column:
    """Readable text: no scripts and comments, block ends as lines, list items as bullets."""
    c = F.regexp_replace(F.regexp_replace(c, _BLOCKS, " "), _BREAKS, "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- "), "<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(decode_entities(c), "(?i)&nbsp;| ", " "), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " *\n *", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Patterns of amounts and of lines about pay. An amount is a whole number of the text, so no part of an address such as
# 170.116.163.254, and no account's or card's number of ten digits and more; the last of several $ marks before a space is none of its own.
_DOLLAR = r"\$(?:(?<!\$\$)\s+)?"
_DIGITS = r"(?:,\d{3})+(?:\.\d+)?(?!\d|\.\d)"
_DOLLARS = rf"{_DOLLAR}(?:\d{{1,3}}{_DIGITS}|\d{{1,9}}(?:\.\d+)?k?(?!\d|\.\d|,\d{{3}}))"
_AMOUNT = rf"{_DOLLARS}|\d(?<!\d\d|\d[.,]\d)\d{{0,2}}{_DIGITS}"
_RANGE = rf"(?i)({_AMOUNT})\s*(?:-|–|—|to|and)\s*({_AMOUNT})"
_SINGLE = rf"(?i){_DOLLARS}"
_PAY_LINE = r"(?i)salary|compensation|pay range|pay rate|pay:|wage|per hour|per year|annually|hourly|base pay|remuneration|\$"


def _amount(c: Column) -> Column:
    """A number of dollars from text such as $95k or 136,000."""
    bare = F.lower(F.regexp_replace(c, r"[,\s$]", ""))
    return F.when(bare.endswith("k"), F.rtrim(bare, F.lit("k")).try_cast("double") * 1000).otherwise(bare.try_cast("double"))


def _period(line: Column, top: Column) -> Column:
    """The period that a line names, else by size; null where neither tells."""
    return (
        F.when(line.rlike(r"(?i)hour|hr\b"), "hour").when(line.rlike("(?i)week"), "week").when(line.rlike("(?i)month"), "month")
        .when(line.rlike("(?i)year|annual|annum"), "year").when(top >= 20_000, "year").when(top <= 500, "hour")
    )


def pay_from_prose(text: Column) -> Column:
    """Struct of pay_min, pay_max, pay_period and pay_raw: the first readable range, else the first
    single dollar amount beside a word for pay; null where there is none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(_PAY_LINE))

    def of_range(x: Column) -> Column:
        a, b = _amount(F.regexp_extract(x, _RANGE, 1)), _amount(F.regexp_extract(x, _RANGE, 2))
        low, high = F.least(a, b), F.greatest(a, b)
        sound = a.isNotNull() & b.isNotNull() & (low > 0) & (high >= low * 0.01) & (
            F.regexp_extract(x, _RANGE, 0).contains("$") | x.rlike("(?i)salary|compensation|pay|wage|remuneration|hour|year|annum|annual")
        )
        return F.struct(
            F.when(sound, low).alias("pay_min"), F.when(sound, high).alias("pay_max"), _period(x, high).alias("pay_period"),
            F.trim(F.regexp_extract(x, _RANGE, 0)).alias("pay_raw"),
        )

    def of_single(x: Column) -> Column:
        v = F.when(x.rlike("(?i)salary|compensation|pay|wage|rate"), _amount(F.regexp_extract(x, _SINGLE, 0)))
        v = F.when(v > 0, v)
        return F.struct(
            v.alias("pay_min"), v.alias("pay_max"), _period(x, v).alias("pay_period"), F.trim(F.regexp_extract(x, _SINGLE, 0)).alias("pay_raw")
        )

    found = lambda make: F.filter(F.transform(lines, make), lambda s: s["pay_min"].isNotNull() & s["pay_period"].isNotNull())
    return F.coalesce(F.try_element_at(found(of_range), F.lit(1)), F.try_element_at(found(of_single), F.lit(1)))


MAX_BULLETS, MIN_BULLET, MAX_BULLET = 12, 20, 320
# Heads of sections, matched against a whole line.
RESPONSIBILITIES = (
    r"(?i)^what you'?ll (do|be doing|own)\b|^(key )?responsibilities\b|^(the )?role\b.{0,20}$|^about the (role|job|position)\b|^in this role\b"
    r"|^day[- ]to[- ]day\b|^your (impact|mission)\b|^you['’]?re excited about (this|the) (opportunity|role|job)\b"
)
REQUIREMENTS = (
    r"(?i)^what you'?ll (need|bring)\b|^(minimum |basic |preferred )?(requirements|qualifications)\b|^what we'?re looking for\b|^(who|what) you are\b"
    r"|^(must|nice)[- ]to[- ]have|^skills( and experience)?\b|^experience\b.{0,20}$|^you (have|bring|will have)\b|^we['’]?re excited about you\b"
)
OTHER_HEAD = (
    r"^[A-Z][^.!?]{2,70}:?$|(?i)^(why join|benefits|perks|compensation|salary|pay|what we offer)\b"
    r"|^(equal opportunity|eeo|diversity|accommodation|privacy|legal|disclaimer)\b|^(how to )?apply\b|^about (us|the company)\b"
)
_BULLET = r"^([-*•·‣]|\d+[.)])\s+"


def sections(text: Column) -> Column:
    """Struct of responsibilities and requirements, at most twelve items each.

    One fold over a row's lines, so the text is never exploded or shuffled. A head opens or ends
    a section; bullets of 20 characters or more are items; prose counts until the first bullet
    and ends a section after it. Lines before the first head that opens a section change nothing
    and are left out; what a line is, is told once, before the fold.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    none = F.array().cast("array<string>")
    start = F.struct(
        F.lit("").alias("open"), F.lit(False).alias("b_resp"), F.lit(False).alias("b_req"), none.alias("resp"), none.alias("req")
    )
    opens = lambda x: (F.length(x) <= 90) & (x.rlike(RESPONSIBILITIES) | x.rlike(REQUIREMENTS))

    def from_first(every: Column) -> Column:
        """The lines from the first on that opens a section."""
        return F.get(F.transform(F.array(F.array_position(F.transform(every, opens), True).cast("int")), lambda n: F.when(n > 0, F.slice(every, n, F.size(every))).otherwise(none)), F.lit(0))

    def told(x: Column) -> Column:
        head = F.when(F.length(x) > 90, "").when(x.rlike(RESPONSIBILITIES), "resp").when(x.rlike(REQUIREMENTS), "req").when(
            x.rlike(OTHER_HEAD) & ~x.rlike(_BULLET), "other"
        ).otherwise("")
        item = F.substring(F.btrim(F.regexp_replace(F.regexp_replace(x, _BULLET, ""), r"\s+", " ")), 1, MAX_BULLET)
        prose = (F.length(x) >= MIN_BULLET) & x.rlike("[.!?]$")
        return F.struct(head.alias("head"), x.rlike(_BULLET).alias("mark"), item.alias("item"), prose.alias("prose"), F.substring(x, 1, MAX_BULLET).alias("line"))

    def step(s: Column, x: Column) -> Column:
        head, mark, item, prose = (x[c] for c in ("head", "mark", "item", "prose"))

        def side(name: str) -> tuple[Column, Column, Column]:
            """Whether this section goes on, has bullets, and its items after the line."""
            here = (s["open"] == name) & (head == "")
            room = F.size(s[name]) < MAX_BULLETS
            bullets = s[f"b_{name}"]
            added = here & room & F.when(mark, F.length(item) >= MIN_BULLET).otherwise(prose & ~bullets)
            new = F.when(mark, item).otherwise(x["line"])
            ends = here & room & ~mark & bullets
            return ends, bullets | (here & room & mark), F.when(added, F.concat(s[name], F.array(new))).otherwise(s[name])

        (end1, b1, resp), (end2, b2, req) = side("resp"), side("req")
        opened = F.when(head.isin("resp", "req"), head).when((head == "other") | end1 | end2, "").otherwise(s["open"])
        return F.struct(opened.alias("open"), b1.alias("b_resp"), b2.alias("b_req"), resp.alias("resp"), req.alias("req"))

    read = F.transform(F.get(F.transform(F.array(lines), from_first), F.lit(0)), told)
    return F.aggregate(read, start, step, lambda s: F.struct(s["resp"].alias("responsibilities"), s["req"].alias("requirements")))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript|svg)\b.*?</(?:script|style|noscript|svg)>|<!--.*?-->', ' ', 'g'),
'(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'), '<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)&nbsp;|' || chr(160), ' ', 'g'), '[ \t]+', ' ', 'g') AS h FROM c)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(h, ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM d"""
)
def sc_html_to_text(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(html_to_text(F.col("html"))).alias("text_md5"))


#: Lines put under descriptions, by posting_id % 6, and what they hold.
_PAY = (
    "(VALUES (0, 'The range is $136,000 - $200,000 per year', 136000.0, 200000.0, 'year', '$136,000 - $200,000'), "
    "(1, 'Base pay of $28.50 per hour', 28.5, 28.5, 'hour', '$28.50'), (2, 'Salary between $95k and $120k', 95000.0, 120000.0, 'year', '$95k and $120k'), "
    "(3, '7 to 10 years of cases', NULL, NULL, NULL, NULL), (4, 'Salary: $120,000 to $90,000', 90000.0, 120000.0, 'year', '$120,000 to $90,000'), "
    "(5, 'pay rate $1,500 weekly', 1500.0, 1500.0, 'week', '$1,500'))"
)
_PAY_LINES = [
    "The range is $136,000 - $200,000 per year", "Base pay of $28.50 per hour", "Salary between $95k and $120k", "7 to 10 years of cases",
    "Salary: $120,000 to $90,000", "pay rate $1,500 weekly",
]


def with_line(df: DataFrame, lines: list[str]) -> DataFrame:
    """Postings whose descriptions end with one of the lines, by posting_id."""
    line = F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("posting_id") % len(lines)).cast("int") + 1)
    return df.withColumn("job_description", F.concat_ws("\n", "job_description", line))


@query(
    f"""WITH {POSTINGS}, a(r, line, pay_min, pay_max, pay_period, pay_raw) AS {_PAY}
SELECT posting_id, a.pay_min::DOUBLE AS pay_min, a.pay_max::DOUBLE AS pay_max, a.pay_period, a.pay_raw FROM postings JOIN a ON posting_id % 6 = r"""
)
def tx_pay_from_prose(spark, sf_dir) -> DataFrame:
    found = with_line(postings(spark, sf_dir), _PAY_LINES).select("posting_id", pay_from_prose(F.col("job_description")).alias("p"))
    return found.select("posting_id", "p.pay_min", "p.pay_max", "p.pay_period", "p.pay_raw")


DEMANDS = [
    "Requirements:\n- Five years of red widget assembly\n- Knowledge of ledger software\n- short\nApplications are read as they come in.",
    "What you'll do:\n- Lead the night crew of the plant\nBenefits\n- Free lunches on every working day",
    "What you'll need:\n- Forklift license and steady hands\n\n- Passionate about fast-paced teams",
]


@query(
    f"""WITH {POSTINGS}, a(r, part, place, item) AS (VALUES (0, 'requirements', 0, 'Five years of red widget assembly'), (0, 'requirements', 1, 'Knowledge of ledger software'),
(1, 'responsibilities', 0, 'Lead the night crew of the plant'), (2, 'requirements', 0, 'Forklift license and steady hands'), (2, 'requirements', 1, 'Passionate about fast-paced teams'))
SELECT posting_id, part, place, item FROM postings JOIN a ON posting_id % 3 = r"""
)
def tx_sections(spark, sf_dir) -> DataFrame:
    found = with_line(postings(spark, sf_dir), DEMANDS).select("posting_id", sections(F.col("job_description")).alias("s"))
    of = lambda part: found.select("posting_id", F.lit(part).alias("part"), F.posexplode(f"s.{part}").alias("place", "item"))
    return of("responsibilities").unionByName(of("requirements"))
