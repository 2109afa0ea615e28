"""Records made of the driver's tables, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import tokenize, words
from quillgraph.plans.vocabulary import MARKERS

AS_OF = "2002-01-01 00:00:00"
EVENTS_AS_OF = "2024-02-15 00:00:00"
TOKEN = "[a-z0-9][a-z0-9_-]{1,}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(words(*values), (F.col(key) % len(values) + 1).cast("int"))


def _markers(**columns: str | Column) -> Column:
    """A map like a stored one: made of arrays, so that the optimiser doesn't take it apart again."""
    return F.map_from_arrays(words(*columns), F.array(*[F.array(F.col(c) if isinstance(c, str) else c) for c in columns.values()]))


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customers: statuses, severities and segments are the tables' own."""
    own = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    own = own.withColumns(
        {
            "status": F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in-progress").otherwise("known-risk"),
            "severity": F.element_at(words("critical", "high", "medium", "low", "low"), F.substring("o_orderpriority", 1, 1).cast("int")),
            "domain": F.lower("c_mktsegment"),
            "type": _pick(MARKERS["type"], "o_orderkey"),
            "goal": _pick(MARKERS["goal"], "o_custkey"),
            "flow": _pick(MARKERS["flow"], "o_orderkey"),
            "artifact": _pick(MARKERS["artifact"], "o_custkey"),
        }
    )
    title = F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "flow", "artifact")
    return own.select(
        F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"),
        title.alias("title"),
        title.alias("content"),
        _markers(**{n: n for n in ("type", "goal", "status", "severity", "domain", "flow", "artifact")}).alias("markers"),
        F.array().cast("array<struct<type:string,target:string,confidence:double>>").alias("relations"),
        tokenize(title).alias("tokens"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        (F.col("o_orderkey") % 10 == 0).alias("archived"),
        F.col("o_orderkey").alias("ingest_ordinal"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("frontmatter"), F.lit("body"))).otherwise(F.array(F.lit("body"))).alias("regions_used"),
        "o_custkey",
        "o_totalprice",
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_tokens(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({text}), '{TOKEN}')))"


ORDERS_SQL = f"""r0 AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, c_mktsegment, o_orderdate AS updated_at, 'order:' || o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in-progress' ELSE 'known-risk' END AS status,
  (['critical','high','medium','low','low'])[substr(o_orderpriority, 1, 1)::INT] AS severity, lower(c_mktsegment) AS domain,
  ({_sql_list(MARKERS["type"])})[o_orderkey % 9 + 1] AS type, ({_sql_list(MARKERS["goal"])})[o_custkey % 6 + 1] AS goal,
  ({_sql_list(MARKERS["flow"])})[o_orderkey % 8 + 1] AS flow, ({_sql_list(MARKERS["artifact"])})[o_custkey % 8 + 1] AS artifact,
  o_orderkey % 10 = 0 AS archived, o_orderkey % 7 = 0 AS explicit
  FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, o_orderpriority || ' ' || c_mktsegment || ' ' || flow || ' ' || artifact AS title, {_sql_tokens("o_orderpriority || ' ' || c_mktsegment || ' ' || flow || ' ' || artifact")} AS tokens FROM r0)"""


#: Relation types of lines by their number, where they are typed.
RELATION_TYPES = ["might_affect", "same_pattern_as", "derived_from", "related_pattern"]


def part_records(spark: SparkSession, folder: str, related: bool = False, typed: bool = False) -> DataFrame:
    """Parts by brand and name. Some words are a flow of one part and an artifact of another. related: each part to
    the next part of each order that it is in; typed: by relations of several types."""
    own = table(spark, folder, "part")
    adjective, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    even = F.col("p_partkey") % 2 == 0
    place = (F.col("p_size") % 10).cast("string")
    own = own.withColumns({"domain": F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), "type": F.lower("p_type"), "flow": F.concat_ws("-", F.when(even, noun).otherwise(adjective), place), "artifact": F.concat_ws("-", F.when(even, adjective).otherwise(noun), place)})
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("size"), F.col("p_size")))
    own = own.withColumn("id", F.concat(F.lit("part:"), F.col("p_partkey")))
    relations = F.array().cast("array<struct<type:string,target:string,confidence:double>>")
    if related:
        lines = table(spark, folder, "lineitem")
        following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        links = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("part:"), following).alias("target")).where("target IS NOT NULL")
        of = links.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "target"))).alias("_of"))
        own = own.join(of, "p_partkey", "left")
        kind = (lambda x: F.element_at(words(*RELATION_TYPES), x["l_linenumber"] % len(RELATION_TYPES) + 1)) if typed else (lambda x: F.lit("related_to"))
        relations = F.coalesce(F.transform("_of", lambda x: F.struct(kind(x).alias("type"), x["target"].alias("target"), F.lit(1.0).alias("confidence"))), relations)
    return own.select("id", F.col("p_name").alias("title"), text.alias("content"), _markers(domain="domain", type="type", flow="flow", artifact="artifact").alias("markers"), relations.alias("relations"), tokenize(text).alias("tokens"), F.lit("2001-12-01").cast("timestamp").alias("updated_at"), F.lit(False).alias("archived"), F.col("p_partkey").alias("ingest_ordinal"), "p_brand", "p_size")


PARTS_SQL = f"""p0 AS (SELECT p_partkey, 'part:' || p_partkey AS id, p_name, p_brand, p_size, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS domain, lower(p_type) AS type,
  CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END || '-' || p_size % 10 AS flow,
  CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END || '-' || p_size % 10 AS artifact,
  {_sql_tokens("p_name || ' ' || p_type || ' ' || p_brand || ' size' || p_size")} AS tokens FROM part)"""

PAIRS_SQL = f"""{PARTS_SQL},
pairs AS (SELECT a.id AS source, b.id AS target, (a.domain = b.domain)::INT AS md, (a.type = b.type)::INT AS mt, (a.flow = b.flow)::INT AS mf, (a.artifact = b.artifact)::INT AS ma,
  (a.flow = b.artifact)::INT + (a.artifact = b.flow)::INT AS halves, list_sort(list_intersect(a.tokens, b.tokens)) AS shared FROM p0 a JOIN p0 b ON a.id != b.id),
e AS (SELECT source, target, CASE WHEN md + mf = 2 THEN 'same_pattern_as' WHEN mf + ma > 0 THEN 'might_affect' ELSE 'related_pattern' END AS type,
  round((15000 * (md + mt + mf + ma) + 7500 * halves + 3125 * least(len(shared), 8)) / 100000.0, 3) AS confidence,
  concat_ws(',', CASE WHEN ma = 1 THEN 'artifact' END, CASE WHEN md = 1 THEN 'domain' END, CASE WHEN mf = 1 THEN 'flow' END, CASE WHEN mt = 1 THEN 'type' END) AS matched,
  array_to_string(shared[1:12], ',') AS shared FROM pairs),
inferred AS (SELECT * FROM e WHERE confidence >= 0.3)"""

LINKS_SQL = f"""links AS (SELECT 'part:' || p AS source, 'part:' || following AS target, ({_sql_list(RELATION_TYPES)})[l_linenumber % {len(RELATION_TYPES)} + 1] AS rel,
  row_number() OVER (PARTITION BY p ORDER BY l_orderkey, l_linenumber, 'part:' || following) - 1 AS ordinal
  FROM (SELECT l_orderkey, l_linenumber, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS following FROM lineitem) WHERE following IS NOT NULL)"""


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as changes of the record of their user, arriving by event_id and edited at ts; every 17th has no time."""
    own = table(spark, folder, "events")
    edited = F.when(F.col("event_id") % 17 != 0, F.col("ts").cast("timestamp") - F.expr("make_interval(0, 0, 0, 0, CAST(event_id % 5 AS INT) * 12)"))
    return own.select(F.concat(F.lit("user:"), F.col("user_id")).alias("id"), F.col("event_id").alias("ordinal"), edited.alias("edited"), "event_type", "value")


CHANGES_SQL = """ch AS (SELECT 'user:' || user_id AS id, event_id AS ordinal, CASE WHEN event_id % 17 != 0 THEN ts - to_hours(((event_id % 5) * 12)::INT) END AS edited, event_type, value FROM events)"""


def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as a cohort for promotion."""
    own = order_records(spark, folder)
    return own.withColumn("cohort", F.concat(F.lit("cust:"), F.col("o_custkey"))).withColumn("ordinal", F.col("ingest_ordinal"))


def conversation_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as a cohort."""
    own = table(spark, folder, "conversations")
    return own.select(F.col("conv_id").alias("cohort"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("ordinal"), F.col("role").alias("title"), F.col("text").alias("content"))
