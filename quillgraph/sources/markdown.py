"""Markdown files as records: front matter, title, links as relations, ids by path or page id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import content_of, front_matter, link_targets, page_id, slugify, title_from_filename, title_of, without_front_matter
from quillgraph.plans.vocabulary import Vocabulary
from quillgraph.sources.cursors import with_freshness

EXPORT = "notion-export"


def files(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = True) -> DataFrame:
    """url, path (relative), modified, text of the files; texts are read only where they are used."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    url = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/")
    return found.select(url.alias("url"), F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root) + 2})").alias("path"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it leads outside."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        outside = state["out"] | (up & (F.size(state["parts"]) == 0))
        parts = F.when(part.isin(".", ""), state["parts"]).when(up, F.slice(state["parts"], 1, F.greatest(F.size(state["parts"]) - 1, F.lit(0)))).otherwise(F.concat(state["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), outside.alias("out"))

    return F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/")))


def ids(system: str, space: str, path: str = "path") -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    plain = F.concat(F.lit("src:"), slugify(F.concat_ws("::", F.lit(system), F.lit(space), F.col(path))))
    return F.coalesce(F.concat(F.lit("notion:"), page_id(stem)), plain) if system == EXPORT else plain


def records(found: DataFrame, space: str, system: str = "markdown", vocabulary: Vocabulary | None = None, among: DataFrame | None = None) -> DataFrame:
    """Unclassified records of files (url, path, modified, text). Links and ``relates_to`` become
    related_to relations; a link is resolved by an equi-join on the normalised relative path with the
    paths of ``among`` (column path), or of the files themselves. No text of ``among`` is read."""
    vocabulary = vocabulary or Vocabulary()
    names = list(dict.fromkeys([*vocabulary.markers, "project", "room", "scope", "owner"]))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    own = found.withColumns({"id": ids(system, space), "_front": front_matter("text"), "_body": without_front_matter("text")})
    own = own.withColumns({"_title": title_of("_body", title_from_filename(stem)), "content": content_of("_body")})
    markers = F.map_filter("_front", lambda k, v: k.isin(*names))
    own = own.withColumns({"title": F.coalesce(F.try_element_at(F.col("_front")["title"], F.lit(1)), F.col("_title")), "markers": markers, "parent": F.try_element_at(F.col("_front")["parent"], F.lit(1))})
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    links = own.select("id", F.posexplode(link_targets("text")).alias("place", "t"), folder.alias("folder")).select("id", "place", normal_path(F.concat("folder", "t")).alias("to"))
    resolved = links.join((found if among is None else among).select(ids(system, space).alias("target"), F.col("path").alias("to")), "to").where("id != target")
    linked = resolved.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "target"))).getField("target").alias("_linked"))
    out = own.join(linked, "id", "left")
    none = F.array().cast("array<string>")
    targets = F.concat(F.coalesce(F.col("_front")["relates_to"], none), F.coalesce("_linked", none))
    relations = F.transform(targets, lambda t: F.struct(F.lit("related_to").alias("type"), t.alias("target"), F.lit(1.0).alias("confidence")))
    return out.select("id", "title", "content", "markers", relations.alias("relations"), F.lit(system).alias("system"), F.lit(space).alias("space"), "path", "url", "parent", F.col("modified").alias("last_edited_time"), F.lit(1).alias("version"))


def fresh_files(found: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files changed after their cursor. Only path and time are compared, before any text is parsed."""
    return with_freshness(found, cursors, "url", "modified").where("fresh").drop("fresh")


def ingest(spark: SparkSession, folder: str, space: str, cursors: DataFrame | None = None, system: str = "markdown", pattern: str = "*.md", recursive: bool = True, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Records of the (fresh) files of a folder; links to files that aren't fresh are resolved too."""
    found = files(spark, folder, pattern, recursive)
    if cursors is None:
        return records(found, space, system, vocabulary)
    return records(fresh_files(found, cursors), space, system, vocabulary, found.select("path"))
