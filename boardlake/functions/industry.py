"""Industries of titles: ordered rules, relabelling of training rows, and a matcher fitted on titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.text import like_text
from boardlake.registry import query
from boardlake.sources.postings import POSTINGS, postings

# Rules in order, the first that a title meets gives its industry.
RULES = (
    ("salesforce_platform_role", "information_technology_software", r"\bsalesforce\b"),
    (
        "sales_exclusive", "sales_business_development",
        r"\b(account executive|account manager|business development|brand ambassador|inside sales|outside sales|sales representative|sales manager"
        r"|sales director|sales consultant|sales specialist|sales associate|sales advisor|presales?|telesales|territory manager|channel sales|partner sales"
        r"|go[\s-]?to[\s-]?market|gtm|revenue operations|sales|salesperson|salesman|salesworker)\b",
    ),
    (
        "hr_recruiting", "human_resources_recruiting",
        r"\b(recruiter|recruiting|talent acquisition|human resources|hr generalist|hr manager|people operations|people partner|staffing specialist|sourcer)\b",
    ),
    (
        "legal_compliance", "legal_compliance",
        r"\b(attorney|counsel|paralegal|legal assistant|litigation|compliance officer|privacy counsel|contracts counsel|general counsel)\b",
    ),
    (
        "finance_accounting", "finance_accounting_banking_insurance",
        r"\b(accountant|accounting|accounts payable|accounts receivable|bookkeeper|controller|cpa|tax specialist|tax analyst|tax manager|payroll specialist"
        r"|payroll analyst|fp&a|financial analyst|financial controller|treasury analyst|underwriter)\b",
    ),
    (
        "marketing_media_design", "marketing_advertising_media_design",
        r"\b(marketing manager|marketing specialist|digital marketing|content strategist|content marketing|social media|seo specialist|sem specialist"
        r"|brand marketing|demand generation|public relations|copywriter)\b",
    ),
    (
        "customer_service_call_center", "customer_service_call_center",
        r"\b(call center|customer service representative|customer support representative|contact center|client service representative)\b",
    ),
    (
        "behavioral_health_social_care", "behavioral_health_social_care",
        r"\b(mental health|behavioral health|social worker|substance abuse counselor|counselor|case worker)\b",
    ),
    (
        "healthcare_medical", "healthcare_medical",
        r"\b(registered nurse|nurse practitioner|licensed practical nurse|lpn|rn|cna|medical assistant|physician|doctor|pharmacist|radiologic technologist"
        r"|medical technologist|sonographer)\b",
    ),
    (
        "education_training_library", "education_training_library",
        r"\b(teacher|instructor|professor|tutor|librarian|adjunct faculty|teaching assistant)\b",
    ),
    (
        "transportation_logistics", "transportation_logistics_warehouse",
        r"\b(cdl|truck driver|delivery driver|forklift operator|warehouse associate|warehouse worker|logistics coordinator|supply chain analyst|dispatcher"
        r"|route driver)\b",
    ),
    (
        "cybersecurity_network_telecom", "cybersecurity_network_telecom",
        r"\b(cybersecurity|information security|security analyst|soc analyst|network engineer|telecom engineer|network administrator)\b",
    ),
    (
        "data_ai_analytics", "data_ai_analytics",
        r"\b(data scientist|machine learning engineer|ml engineer|ai engineer|ai scientist|business intelligence|bi analyst|data engineer|data analyst"
        r"|analytics engineer)\b",
    ),
    (
        "information_technology_software", "information_technology_software",
        r"\b(software engineer|software developer|full stack developer|frontend developer|backend developer|devops engineer|site reliability engineer"
        r"|systems administrator|software architect|qa engineer|test automation engineer)\b",
    ),
)
# How often a word or phrase must come in an industry, and in how many industries it says nothing.
MIN_WORD, MIN_PHRASE, SHARED = 3, 2, 2


def rule(title: Column) -> Column:
    """Struct of the first rule's name and industry, or null."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(
        *[F.when(text.rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(key).alias("industry"))) for name, key, pattern in RULES]
    )


def relabel(training: DataFrame, title: str = "title", industry: str = "industry") -> DataFrame:
    """The rows that a rule moves to another industry, with rule and to_industry."""
    found = training.withColumn("_r", rule(F.col(title))).filter("_r is not null")
    return found.filter(~F.col(industry).eqNullSafe(F.col("_r.industry"))).select(
        title, F.col(industry).alias("from_industry"), F.col("_r.industry").alias("to_industry"), F.col("_r.rule").alias("rule")
    )


def title_parts(title: Column) -> Column:
    """Words of three letters or more."""
    return F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def grams(words: Column) -> Column:
    """Distinct single words and runs of two and three."""
    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, runs(2), runs(3)))


def matcher(training: DataFrame, title: str = "title", industry: str = "industry") -> DataFrame:
    """industry, gram, titles (that have it), industries (that use it), kept (it marks the industry).

    Counts add up before each shuffle, and the number of industries of a gram comes from the
    counts, so a word that all titles have moves no more rows than a rare one.
    """
    titles = training.select(industry, like_text(F.col(title)).alias("_t")).distinct()
    counts = (
        titles.select(F.col(industry).alias("industry"), F.explode(grams(title_parts(F.col("_t")))).alias("gram"))
        .groupBy("industry", "gram").agg(F.count("*").alias("titles"))
    )
    spread = counts.groupBy("gram").agg(F.count("*").alias("industries"))
    least = F.when(F.col("gram").contains(" "), MIN_PHRASE).otherwise(MIN_WORD)
    return counts.join(spread, "gram").select(
        "industry", "gram", "titles", "industries", ((F.col("titles") >= least) & (F.col("industries") < SHARED)).alias("kept")
    )


def of_industry(df: DataFrame, key: str, title: str, fitted: DataFrame) -> DataFrame:
    """key, industry: the industries whose marks a title has. Titles of sales belong to sales alone."""
    titles = df.select(F.col(title).alias("_t")).distinct().withColumn("_r", rule(F.col("_t")))
    sales = F.coalesce(F.col("_r.rule") == "sales_exclusive", F.lit(False))
    marks = fitted.filter("kept").select("gram", "industry")
    free = titles.filter(~sales).select("_t", F.explode(grams(title_parts(F.col("_t")))).alias("gram")).join(marks, "gram").select("_t", "industry").distinct()
    found = free.unionByName(titles.filter(sales).select("_t", F.col("_r.industry").alias("industry")))
    return df.select(key, F.col(title).alias("_title")).join(found, F.col("_title") == F.col("_t")).select(key, "industry")


#: Ends of titles by posting_id % 8, the rule they meet and its industry.
_ENDS = (
    ("Salesforce Administrator", "salesforce_platform_role", "information_technology_software"),
    ("Inside Sales Lead", "sales_exclusive", "sales_business_development"),
    ("Staff Accountant", "finance_accounting", "finance_accounting_banking_insurance"),
    ("RN, night shift", "healthcare_medical", "healthcare_medical"),
    ("Forklift Operator", "transportation_logistics", "transportation_logistics_warehouse"),
    ("Data Engineer / Counsel", "legal_compliance", "legal_compliance"),
    ("DevOps Engineer", "information_technology_software", "information_technology_software"),
    ("Assembler", None, None),
)
_LABELS = ("sales_business_development", "healthcare_medical", "legal_compliance")
_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_ANSWERS = "a(r, ending, rule, key) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, row))})" for i, row in enumerate(_ENDS)) + ")"
_TRAINING = f"""t AS (SELECT p_name || ' ' || ending AS title, (['{"', '".join(_LABELS)}'])[CAST(p_partkey // 8 % 3 AS INT) + 1] AS industry, rule, key
FROM part JOIN a ON p_partkey % 8 = r)"""


def _ending(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x[0]) for x in _ENDS]), (number % len(_ENDS)).cast("int") + 1)


def titled(spark, sf_dir) -> DataFrame:
    """Postings whose titles end with one of the ends."""
    return postings(spark, sf_dir).select("posting_id", F.concat_ws(" ", "position_name", _ending(F.col("posting_id"))).alias("title"))


def training(spark, sf_dir) -> DataFrame:
    """Titles of parts with labels, some of them wrong."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.floor(F.col("p_partkey") / 8) % 3).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_name", _ending(F.col("p_partkey"))).alias("title"), label.alias("industry"))


@query(f"WITH {POSTINGS}, {_ANSWERS} SELECT posting_id, rule, key AS industry FROM postings JOIN a ON posting_id % 8 = r")
def tx_industry_rule(spark, sf_dir) -> DataFrame:
    return titled(spark, sf_dir).withColumn("r", rule(F.col("title"))).select("posting_id", "r.rule", "r.industry")


@query(
    f"""WITH {_ANSWERS}, {_TRAINING} SELECT industry AS from_industry, key AS to_industry, rule, count(*) AS n FROM t WHERE key <> industry
GROUP BY 1, 2, 3 ORDER BY n DESC, from_industry, to_industry, rule LIMIT 25"""
)
def tx_relabel_industries(spark, sf_dir) -> DataFrame:
    """The 25 largest movements between industries."""
    moved = relabel(training(spark, sf_dir)).groupBy("from_industry", "to_industry", "rule").agg(F.count("*").alias("n"))
    return moved.orderBy(F.desc("n"), "from_industry", "to_industry", "rule").limit(25)


_GRAMS = f"""u AS (SELECT DISTINCT coalesce(key, 'other') AS industry, lower(title) AS title FROM t),
w AS (SELECT industry, list_filter(regexp_split_to_array(title, '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM u),
g AS (SELECT industry, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM w),
c AS (SELECT industry, gram, count(*) AS titles FROM g GROUP BY 1, 2), d AS (SELECT gram, count(*) AS industries FROM c GROUP BY 1),
m AS (SELECT industry, gram, titles, industries, titles >= CASE WHEN contains(gram, ' ') THEN {MIN_PHRASE} ELSE {MIN_WORD} END AND industries < {SHARED} AS kept
FROM c JOIN d USING (gram))"""


def _ruled(spark, sf_dir) -> DataFrame:
    """Training titles under the industries that the rules give."""
    return training(spark, sf_dir).select("title", F.coalesce(rule(F.col("title"))["industry"], F.lit("other")).alias("industry"))


@query(f"WITH {_ANSWERS}, {_TRAINING}, {_GRAMS} SELECT * FROM m")
def ag_train_industry(spark, sf_dir) -> DataFrame:
    return matcher(_ruled(spark, sf_dir))


@query(
    f"""WITH {POSTINGS}, {_ANSWERS}, {_TRAINING}, {_GRAMS},
p AS (SELECT posting_id, posting_id % 8 = 1 AS sales, list_filter(regexp_split_to_array(lower(position_name || ' ' || ending), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w
FROM postings JOIN a ON posting_id % 8 = r),
q AS (SELECT posting_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM p WHERE NOT sales)
SELECT DISTINCT posting_id, industry FROM q JOIN m USING (gram) WHERE kept UNION ALL SELECT posting_id, 'sales_business_development' FROM p WHERE sales"""
)
def q_industry(spark, sf_dir) -> DataFrame:
    return of_industry(titled(spark, sf_dir), "posting_id", "title", matcher(_ruled(spark, sf_dir)))
