"""The outbox: what waits to be pushed, and the plan of creates, updates and skips."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import words
from quillgraph.operators.classify import scalar

# Fixed values.
PUSHABLE = ("rule", "decision", "gotcha", "module-boundary", "convention", "task", "bug", "bug-fix")


def pushable(records: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Records of a pushable type; explicit ids are taken whatever their type, in their order, unknown ones dropped."""
    if ids is None:
        return records.where(scalar("markers", "type").isin(*PUSHABLE)).withColumn("ordinal", F.col("ingest_ordinal"))
    place = F.array_position(words(*ids), F.col("id")) if ids else F.lit(0)
    return records.withColumn("ordinal", place).where("ordinal > 0")


def select_ids(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of ``wanted`` (id, ordinal), with its ordinal."""
    return records.join(wanted, "id")


def enqueue(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue with new ids (id, ordinal) after those in it; an id waits once, at its first place."""
    last = outbox.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_last"))
    fresh = ids.groupBy("id").agg(F.min("ordinal").alias("ordinal")).join(outbox.select("id"), "id", "left_anti")
    moved = fresh.join(last).select("id", (F.col("ordinal") + F.col("_last") + 1).cast("bigint").alias("ordinal"))
    return outbox.select("id", "ordinal").unionByName(moved)


def dequeue(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    return outbox.join(ids.select("id"), "id", "left_anti")


def parent_page(markers: str, parent: str, pages: Mapping[str, str], root: str | None) -> Column:
    """The page under which a record goes: a directory named by its marker, else the deepest
    breadcrumb segment that is a directory (with or without a slash), else the root."""
    table = F.create_map(*[F.lit(x) for pair in pages.items() for x in pair]) if pages else F.create_map().cast("map<string,string>")

    def look(name: Column) -> Column:
        return F.coalesce(table[name], table[F.concat(name, F.lit("/"))])

    segments = F.reverse(F.filter(F.transform(F.split(F.coalesce(F.col(parent), F.lit("")), ">"), lambda x: F.trim(x)), lambda s: s != ""))
    deepest = F.try_element_at(F.filter(F.transform(segments, look), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(look(F.coalesce(scalar(markers, "notionDir"), F.lit(""))), deepest, F.lit(root))


def push_plan(outbox: DataFrame, records: DataFrame, state: DataFrame, pages: Mapping[str, str], root: str | None) -> DataFrame:
    """id, ordinal, action (create, update or skip), reason, page_id, parent_page_id, revision for each waiting id.

    Without a root page nothing is planned: every id is skipped as blocked."""
    own = records.select("id", F.lit(True).alias("_there"), scalar("markers", "type").alias("_type"), F.col("arbiter").alias("_arbiter"), F.col("version").alias("revision"), parent_page("markers", "parent", pages, root).alias("parent_page_id"))
    sent = state.select("id", "page_id", F.col("revision").alias("_sent"))
    plan = outbox.join(own, "id", "left").join(sent, "id", "left")
    reason = (
        F.when(F.lit(root is None), "no-root-page")
        .when(F.col("_there").isNull(), "missing-from-graph")
        .when(~F.coalesce(F.col("_type").isin(*PUSHABLE), F.lit(False)), "non-pushable-type")
        .when(F.col("_arbiter") == "pending-arbitration", "pending-arbitration")
        .when(F.col("parent_page_id").isNull(), "no-parent-resolved")
        .when(F.col("page_id").isNotNull() & (F.col("revision") <= F.col("_sent")), "no-revision-change")
    )
    plan = plan.withColumn("reason", reason)
    action = F.when(F.col("reason").isNotNull(), "skip").when(F.col("page_id").isNotNull(), "update").otherwise("create")
    return plan.select("id", "ordinal", action.alias("action"), "reason", "page_id", "parent_page_id", "revision")


def apply_results(outbox: DataFrame, state: DataFrame, results: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(outbox, state) after pushes (id, page_id, revision): done ids stop waiting, their state is replaced."""
    new = results.select("id", "page_id", F.col("revision").cast("int").alias("revision"), F.to_timestamp(F.lit(as_of)).alias("pushed_at"))
    return dequeue(outbox, results), state.join(new.select("id"), "id", "left_anti").select("id", "page_id", "revision", "pushed_at").unionByName(new)


def cleaned_state(state: DataFrame) -> DataFrame:
    """The state without entries that have no page."""
    return state.where("page_id IS NOT NULL AND page_id != ''")


def ingest_root(url: str = "url", path: str = "path") -> Column:
    """A record's url without its relative path, or null where it doesn't end so."""
    u, p = F.col(url), F.col(path)
    return F.when((F.coalesce(p, F.lit("")) != "") & ~p.startswith("/") & u.endswith(F.concat(F.lit("/"), p)), F.substring(u, F.lit(1), F.length(u) - F.length(p) - 1))


def best_root(records: DataFrame, folder: str) -> DataFrame:
    """One row: the deepest ingest root that holds the folder, or null. Only records read from files count."""
    root = records.where(F.col("system").isin("markdown", "notion-export")).select(ingest_root().alias("root"))
    inside = root.where(F.col("root").isNotNull() & F.concat(F.lit(folder), F.lit("/")).startswith(F.concat("root", F.lit("/"))))
    return inside.agg(F.max_by("root", F.length("root")).alias("root"))
