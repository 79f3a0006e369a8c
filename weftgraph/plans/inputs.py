"""Graph inputs derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = r'<a href="/[^"]*">([^<]*)</a>'
#: A small rule table over syllables of the tables' invented prose, in the form of the published ones.
RULES = {"LEADS": ["eron", "aient"], "FOLLOWS": ["ndth", "uier"], "KIN_OF": ["esth", "chach"], "ALLY_OF": ["thing", "ción"]}
WEIGHTS = {"LINKS_TO": 1, "ALLY_OF": 3, "LEADS": 5, "FOLLOWS": 5, "KIN_OF": 8}
INVERSE = {"LEADS": "FOLLOWS", "FOLLOWS": "LEADS", "KIN_OF": "KIN_OF"}
FLIPS = [("LEADS", ["that"], "FOLLOWS"), ("FOLLOWS", ["with"], "LEADS")]
GENERIC = "LINKS_TO"
PATTERNS = {"eron": "LEADS", "aient": "LEADS", "esth": "KIN_OF", "thing": "ALLY_OF"}
CLASSES = [(["eron", "aient"], "LEADS"), (["thing", "ción"], "ALLY_OF"), (["esth"], "KIN_OF")]


def articles(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.concat(F.lit("doc_"), "doc_id").alias("title"), "text")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """page_id, pos, anchor: link texts of the pages, in order."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 1)).alias("pos", "anchor"))


def titles(spark: SparkSession, d: str, least: int = 4) -> DataFrame:
    """lowered, title: distinct lowered anchors of at least ``least`` characters."""
    low = anchors(spark, d).select(F.lower("anchor").alias("lowered")).distinct()
    return low.where(F.length("lowered") >= least).select("lowered", F.col("lowered").alias("title"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """source, target, type: customer nation to supplier nation, once for each order line."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    rows = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    names = t("nation").select("n_nationkey", "n_name")
    a, b = names.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("source")), names.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("target"))
    return rows.join(a, F.col("c_nationkey") == F.col("ka")).join(b, F.col("s_nationkey") == F.col("kb")).select("source", "target", F.col("l_returnflag").alias("type"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """The triples of :func:`trade` with a tenth more lines than the average triple: strong links."""
    counted = trade(spark, d).groupBy("source", "target", "type").agg(F.count("*").alias("n"))
    whole = counted.agg(F.count("*").alias("triples"), F.sum("n").alias("lines"))
    return counted.join(F.broadcast(whole)).where(F.col("n") * F.col("triples") * 10 > F.col("lines") * 11).select("source", "target", "type")


def parties(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers (title), and the distinct edges between them that all order lines make."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nodes = t("customer").select(name("C", "c_custkey").alias("title")).unionByName(t("supplier").select(name("S", "s_suppkey").alias("title")))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return nodes, lines.select(name("C", "o_custkey").alias("source"), name("S", "l_suppkey").alias("target"), F.col("l_returnflag").alias("type")).distinct()


def nations(spark: SparkSession, d: str) -> DataFrame:
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("title"), F.col("r_name").alias("summary"), F.col("n_nationkey").cast("long").alias("page_id"))


SQL_ARTICLES = "articles AS (SELECT 'doc_' || doc_id AS title, text FROM documents)"
SQL_ANCHORS = "anchor_lists AS (SELECT page_id, regexp_extract_all(html, '<a href=\"/[^\"]*\">([^<]*)</a>', 1) AS l FROM pages), anchors AS (SELECT page_id, i - 1 AS pos, l[i] AS anchor FROM anchor_lists, range(1, len(l) + 1) r(i))"
SQL_TITLES = SQL_ANCHORS + ", titles AS (SELECT DISTINCT lower(anchor) AS lowered, lower(anchor) AS title FROM anchors WHERE length(anchor) >= 4)"
SQL_TRADE = "trade AS (SELECT a.n_name AS source, b.n_name AS target, l_returnflag AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey), counted AS (SELECT source, target, type, count(*) AS n FROM trade GROUP BY source, target, type), edges AS (SELECT source, target, type FROM counted WHERE n * (SELECT count(*) FROM counted) * 10 > (SELECT sum(n) FROM counted) * 11)"
SQL_NATIONS = "nodes AS (SELECT n_name AS title, r_name AS summary, CAST(n_nationkey AS BIGINT) AS page_id FROM nation JOIN region ON n_regionkey = r_regionkey)"


def sql_any(low: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{k}')" for k in keywords) + ")"


def sql_case(low: str, classes: list[tuple[list[str], str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(low, k)} THEN '{t}'" for k, t in classes) + f" ELSE '{default}' END"


def sql_sentences(text: str, strict: bool) -> str:
    """A list of sentences; RE2 has no lookbehind, so a sign marks the cuts."""
    space = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    if strict:
        return f"string_split(regexp_replace({text}, '([.?!]){space}+([A-ZĐ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    edge = f"^{space}+|{space}+$"
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([.?!]){space}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{edge}', '', 'g')), lambda x: x <> '')"
