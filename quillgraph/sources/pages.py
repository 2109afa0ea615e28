"""Sync with a page service through a client that the caller gives: pull with cursors, push of a plan.

The network is outside the engine. A client lists pages, hydrates blocks and creates or
updates pages; the engine decides what is fresh and what to do, as tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.blocks import markdown_to_blocks, pages_to_records
from quillgraph.sources.cursors import advanced, floored, with_freshness

NESTED = ("table", "toggle", "callout", "column", "column_list")


class Client(Protocol):
    def list_pages(self, database_id: str | None, parent_id: str | None, cursor: str | None) -> dict: ...
    def list_blocks(self, block_id: str, cursor: str | None) -> dict: ...
    def create_page(self, parent_id: str, title: str, blocks: list[dict]) -> dict: ...
    def update_page(self, page_id: str, blocks: list[dict]) -> dict: ...


def paged(call: Callable[[str | None], dict]) -> Iterator[dict]:
    """All results of a paginated call."""
    cursor = None
    while True:
        answer = call(cursor)
        yield from answer.get("results") or []
        cursor = answer.get("next_cursor")
        if not answer.get("has_more") or not cursor:
            return


def hydrated(client: Client, block_id: str) -> list[dict]:
    """Blocks with the children of nested kinds under ``_children``."""
    out = []
    for block in paged(lambda c: client.list_blocks(block_id, c)):
        if block.get("has_children") and block.get("type") in NESTED:
            block = {**block, "_children": hydrated(client, block["id"])}
        out.append(block)
    return out


def pull(spark: SparkSession, make_client: Callable[[], Client], cursors: DataFrame, database_id: str | None = None, parent_id: str | None = None, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, cursors) of pages edited after their cursor. Blocks of stale pages aren't fetched, and
    those of fresh ones are fetched by the executors."""
    if bool(database_id) == bool(parent_id):
        raise ValueError("give either a database or a parent page")
    listed = [(p.get("id"), p.get("last_edited_time"), json.dumps(p)) for p in paged(lambda c: make_client().list_pages(database_id, parent_id, c))]
    pages = spark.createDataFrame(listed, "page_key string, edited_text string, page string").withColumn("edited", F.try_to_timestamp("edited_text"))
    fresh = with_freshness(pages, floored(cursors, since), "page_key", "edited", since).where("fresh")

    @F.udf("string")
    def blocks_of(page_id: str) -> str:
        return json.dumps(hydrated(make_client(), page_id))

    records = pages_to_records(fresh.withColumn("blocks", blocks_of("page_key")))
    return records, advanced(cursors, fresh, "page_key", "edited")


def push(plan: DataFrame, records: DataFrame, client: Client, dry_run: bool = True) -> list[dict]:
    """What a plan does, and with dry_run off does it: one call for each create or update, results as they come."""
    todo = plan.where("action != 'skip'").join(records.select("id", "title", "content"), "id").orderBy("ordinal")
    blocks = markdown_to_blocks(todo).groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "type", "text", "language", "checked")))).alias("blocks"))
    done = []
    for row in todo.join(blocks, "id", "left").orderBy("ordinal").toLocalIterator():
        result = {"id": row["id"], "action": row["action"], "page_id": row["page_id"], "revision": row["revision"]}
        if not dry_run:
            own = json.loads(row["blocks"] or "[]")
            answer = client.create_page(row["parent_page_id"], row["title"], own) if row["action"] == "create" else client.update_page(row["page_id"], own)
            result["page_id"] = answer.get("id") or row["page_id"]
        done.append(result)
    return done
