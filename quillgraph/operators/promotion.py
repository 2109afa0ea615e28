"""Promotion of repeated patterns: consensus and conflict within cohorts, and the rule made of them.

Every operator takes ``cohort`` as a key, so many cohorts run in one job: members have
cohort, id, ordinal, title, content, markers, tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.tables import stored
from quillgraph.functions.text import STOPWORDS, negation_tokens, slugify, words
from quillgraph.operators.classify import classify
from quillgraph.plans.vocabulary import Vocabulary

# Fixed values.
CONSIDERED = ("type", "goal", "status", "severity", "domain", "flow", "artifact", "project", "room", "scope")
SPLIT_ORDER = ("type", "goal", "artifact", "status", "severity", "flow", "domain")
SEVERITIES = ("low", "medium", "high", "critical")


def long_markers(members: DataFrame) -> DataFrame:
    """cohort, id, ordinal, field, value; a list counts as one value."""
    each = members.select("cohort", "id", "ordinal", F.explode("markers").alias("field", "v")).where(F.size("v") > 0)
    return each.select("cohort", "id", "ordinal", "field", F.array_join("v", ", ").alias("value"))


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cohort").agg(F.count("*").alias("members"))


def field_values(members: DataFrame) -> DataFrame:
    """cohort, field, value, n, first: how often each value is, and where first."""
    return long_markers(members).groupBy("cohort", "field", "value").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


def _values(members: DataFrame, values: DataFrame | None) -> DataFrame:
    """``field_values`` of the members, where they aren't given."""
    return field_values(members) if values is None else values


def common_markers(members: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """cohort, field, value of markers that all members have alike."""
    counted = _values(members, values).groupBy("cohort", "field").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("value").alias("value"))
    return counted.join(sizes(members), "cohort").where("kinds = 1 AND n = members").select("cohort", "field", "value")


def marker_conflicts(members: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """cohort, field, values (ascending) of markers with several values. Without counts at hand the tasks' sets of values are joined, so rows are dealt once."""
    own = long_markers(members) if values is None else values
    return own.groupBy("cohort", "field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def majority(members: DataFrame, field: str, values: DataFrame | None = None) -> DataFrame:
    """cohort, value: the most frequent value of a marker, of equals the first seen."""
    own = _values(members, values).where(F.col("field") == field)
    return own.groupBy("cohort").agg(F.min_by("value", F.struct(-F.col("n"), "first")).alias("value"))


def strongest_severity(members: DataFrame) -> DataFrame:
    own = long_markers(members).where("field = 'severity'").where(F.col("value").isin(*SEVERITIES))
    return own.groupBy("cohort").agg(F.max_by("value", F.array_position(words(*SEVERITIES), F.col("value"))).alias("severity"))


def shared_keywords(members: DataFrame, limit: int = 8) -> DataFrame:
    """cohort, keyword, rank: tokens that all members have, ascending; where there is none, the most frequent ones."""
    each = members.select("cohort", "id", F.explode(F.array_distinct("tokens")).alias("keyword")).where((F.length("keyword") > 2) & ~F.col("keyword").isin(*STOPWORDS))
    counted = each.groupBy("cohort", "keyword").agg(F.count("*").alias("n")).join(sizes(members), "cohort")
    most = counted.groupBy("cohort").agg(F.max("n").alias("most"))
    kept = counted.join(most, "cohort").where("n = members OR most < members")
    rank = F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("n"), "keyword"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("cohort", "keyword", "rank")


def promotion_quality(members: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """cohort, considered, consensus, conflicts, score, recommendation (safe, review, split)."""
    values = _values(members, values).groupBy("cohort", "field").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).join(sizes(members), "cohort")
    considered = F.col("field").isin(*CONSIDERED)
    out = values.groupBy("cohort").agg(F.count_if(considered).alias("considered"), F.count_if(considered & (F.col("kinds") == 1) & (F.col("n") == F.col("members"))).alias("consensus"), F.count_if(F.col("kinds") > 1).alias("conflicts"))
    rest = F.greatest(F.col("considered") - F.col("consensus") - F.col("conflicts"), F.lit(0))
    out = out.withColumn("score", F.round((F.col("consensus") + 0.5 * rest) / F.greatest("considered", F.lit(1)), 3))
    return out.withColumn("recommendation", F.when(F.col("conflicts") == 0, "safe").when(F.col("conflicts") <= 2, "review").otherwise("split"))


def split_suggestions(members: DataFrame, limit: int = 3) -> DataFrame:
    """cohort, marker, place, value, group_size, group_rank: the first ``limit`` conflicting markers, their groups by size."""
    groups = field_values(members).select("cohort", F.col("field").alias("marker"), "value", F.col("n").alias("group_size"))
    of = Window.partitionBy("cohort", "marker")
    groups = groups.withColumns({"kinds": F.count("*").over(of), "group_rank": F.row_number().over(of.orderBy(F.desc("group_size"), "value"))}).where("kinds > 1")
    known = F.array_position(words(*SPLIT_ORDER), F.col("marker"))
    order = Window.partitionBy("cohort").orderBy(F.when(known > 0, known).otherwise(len(SPLIT_ORDER) + 1), "marker")
    return groups.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= limit).select("cohort", "marker", "place", "value", "group_size", "group_rank")


def stances(members: DataFrame) -> DataFrame:
    """cohort, id, token, affirmed, negated for tokens of at least four characters that aren't stopwords."""
    text = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("title", F.lit("")))
    each = members.select("cohort", "id", F.explode(negation_tokens(text)).alias("t")).where((F.length("t.token") >= 4) & ~F.col("t.token").isin(*STOPWORDS))
    return each.groupBy("cohort", "id", F.col("t.token").alias("token")).agg(F.bool_or(~F.col("t.negated")).alias("affirmed"), F.bool_or("t.negated").alias("negated"))


def content_conflicts(members: DataFrame) -> DataFrame:
    """cohort, token, affirmative, negated: how many members only affirm and only negate a token."""
    sides = stances(members).groupBy("cohort", "token").agg(F.count_if(F.col("affirmed") & ~F.col("negated")).alias("affirmative"), F.count_if(F.col("negated") & ~F.col("affirmed")).alias("negated"))
    return sides.where("affirmative > 0 AND negated > 0")


def sources(records: DataFrame, wanted: DataFrame, incoming: DataFrame | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Members for ``promote``: of each cohort first the stored records that it asks for (cohort, id, ordinal), in that order and
    without unknown ids, then the incoming ones (cohort and columns of a record), classified, in order of arrival."""
    columns = ["id", "title", "content", "markers"]
    stored = records.select(*columns).join(wanted.select("cohort", "id", F.col("ordinal").cast("bigint").alias("ordinal")), "id").select("cohort", "ordinal", *columns)
    if incoming is None:
        return stored
    fresh = classify(incoming, vocabulary).select("cohort", (F.monotonically_increasing_id() + F.lit(1 << 32)).alias("ordinal"), *columns)
    return stored.unionByName(fresh)


def conflict_members(members: DataFrame) -> DataFrame:
    """cohort, token, id, side of every member on one side of a content conflict."""
    own = stances(members).where("affirmed != negated")
    return own.join(content_conflicts(members).select("cohort", "token"), ["cohort", "token"]).select("cohort", "token", "id", F.when(F.col("affirmed"), "affirmative").otherwise("negated").alias("side"))


def dominant_conflict(members: DataFrame) -> DataFrame:
    """cohort, token: the conflict that splits the cohort most evenly, of equals the first token."""
    balance = F.least("affirmative", "negated") / F.greatest("affirmative", "negated")
    return content_conflicts(members).groupBy("cohort").agg(F.min_by("token", F.struct(-balance, "token")).alias("token"))


def split_by_conflict(members: DataFrame) -> DataFrame:
    """members with cohort narrowed to ``cohort/stance`` where the cohort has a dominant conflict;
    members on neither or both sides of it are in no part, cohorts without one stay whole."""
    main = dominant_conflict(members)
    sides = stances(members).where("affirmed != negated").join(main, ["cohort", "token"]).select("cohort", "id", F.when(F.col("affirmed"), "affirmative").otherwise("negated").alias("stance"))
    split = members.join(sides, ["cohort", "id"]).withColumn("cohort", F.concat_ws("/", "cohort", "stance"))
    return members.join(main.select("cohort"), "cohort", "left_anti").withColumn("stance", F.lit("all")).unionByName(split.select(*members.columns, "stance"))


def promoted_title(domain: Column, flow: Column, kind: str) -> Column:
    return F.initcap(F.concat_ws(" ", F.replace(domain, F.lit("-"), F.lit(" ")), F.replace(flow, F.lit("-"), F.lit(" ")), F.lit("decision" if kind == "decision" else "rule")))


def promote(members: DataFrame, kind: str = "rule", goal: str | None = None, split: bool = True) -> DataFrame:
    """A rule or decision for each cohort: cohort, id, title, content, markers, relations (derived_from), quality.

    A cohort's members are listed in its record, which is what a promoted record is; cohorts
    are chosen by people and small. Members, their parts and the values of these are written once and read by every section."""
    members = stored(members.select("cohort", "id", "ordinal", "title", "content", "markers", "tokens"), "members")
    own = stored(split_by_conflict(members), "parts") if split else members.withColumn("stance", F.lit("all"))
    values = stored(field_values(own), "values")
    common = common_markers(own, values).groupBy("cohort").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("common"))
    quality = promotion_quality(own, values).select("cohort", F.struct("considered", "consensus", "conflicts", "score", "recommendation").alias("quality"))
    conflicts = marker_conflicts(own, values).groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("field", "values"))).alias("conflicts"))
    keywords = shared_keywords(own).groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).getField("keyword").alias("keywords"))
    listed = own.groupBy("cohort").agg(F.count("*").alias("n"), F.first("stance").alias("stance"), F.array_sort(F.collect_list(F.struct("ordinal", "id", "title"))).alias("of"))
    out = listed
    for part in (common, quality, conflicts, keywords, strongest_severity(own), majority(own, "goal", values).withColumnRenamed("value", "most_goal")):
        out = out.join(part, "cohort", "left")
    shared = F.coalesce("common", F.create_map().cast("map<string,string>"))
    base = promoted_title(shared["domain"], shared["flow"], kind)
    title = F.when(F.col("stance") == "all", base).otherwise(F.concat_ws(" ", base, F.concat(F.lit("("), F.col("stance"), F.lit(")"))))
    kept = F.map_filter(shared, lambda k, v: k.isin("domain", "flow", "artifact", "project", "room", "scope"))
    fixed = F.create_map(F.lit("type"), F.lit(kind), F.lit("goal"), F.lit(goal) if goal else F.coalesce("most_goal", F.lit("prevent-regression")), F.lit("status"), F.lit("done"))
    severity = F.when(F.col("severity").isNotNull(), F.create_map(F.lit("severity"), F.col("severity"))).otherwise(F.create_map().cast("map<string,string>"))
    markers = F.transform_values(F.map_concat(fixed, kept, severity), lambda k, v: F.array(v))

    def section(head: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{head}:\n"), F.array_join(lines, "\n"))).otherwise("")

    none = F.array().cast("array<string>")
    content = F.concat(
        F.format_string("Promoted from %d related records.\nPromotion quality: %s (%s).", "n", "quality.recommendation", F.col("quality.score").cast("string")),
        section("Common markers", F.transform(F.map_entries(shared), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))),
        section("Conflicts", F.coalesce(F.transform("conflicts", lambda c: F.concat(F.lit("- "), c["field"], F.lit(": "), F.array_join(c["values"], ", "))), none)),
        section("Shared keywords", F.coalesce(F.array(F.concat(F.lit("- "), F.array_join("keywords", ", "))), none)),
        section("Derived from", F.transform("of", lambda m: F.concat(F.lit("- "), m["id"], F.lit(": "), F.coalesce(m["title"], F.lit(""))))),
    )
    relations = F.transform("of", lambda m: F.struct(F.lit("derived_from").alias("type"), m["id"].alias("target"), F.lit(1.0).alias("confidence")))
    return out.select("cohort", F.concat(F.lit("promoted:"), slugify(title)).alias("id"), title.alias("title"), content.alias("content"), markers.alias("markers"), relations.alias("relations"), "quality")
