"""Stores, files, pages, cursors, workspace and the stream."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillgraph.plans import workspace as ws
from quillgraph.plans.schemas import RECORD, as_records
from quillgraph.sources import blocks as bl
from quillgraph.sources import cursors as cu
from quillgraph.sources import markdown as md
from quillgraph.sources import pages as pg
from quillgraph.sources.store import Store, index, learn

AS_OF = "2024-03-01 00:00:00"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have this module


def _incoming(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, content string, last_edited_time string, ingest_ordinal bigint").withColumn("last_edited_time", F.try_to_timestamp("last_edited_time"))


def test_index_and_dry_run(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = _incoming(spark, [("a", "webhook payments rule", "callback deposit retry", "2024-01-02", 0), ("b", "webhook payments bug", "callback deposit retry", "2024-01-02", 1)])
    assert index(store, rows, AS_OF, dry_run=True)["records"] == 2 and not store.exists("records")
    first = index(store, rows, AS_OF)
    assert first["records"] == 2 and store.load("token_df").count() > 3
    late = _incoming(spark, [("a", "older", "", "2024-01-01", 2), ("c", "c", "", None, 3)])
    assert index(store, late, AS_OF)["records"] == 3
    held = {r["id"]: r for r in store.load("records").collect()}
    assert held["a"]["title"] == "webhook payments rule" and held["a"]["version"] == 1
    index(store, _incoming(spark, [("a", "newer", "", "2024-02-01", 4)]), AS_OF)
    assert store.load("records").where("id = 'a'").first()["version"] == 2
    assert learn(store) >= 0


def test_tables_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *tokens: spark.createDataFrame([(t, 1) for t in tokens], "token string, df bigint")
    store.save("token_df", rows("a"))
    name = store.stage("token_df", rows("b"))
    assert [r["token"] for r in Store(spark, str(tmp_path)).load("token_df").collect()] == ["a"]
    store.commit({"token_df": name})
    assert [r["token"] for r in store.load("token_df").collect()] == ["b"] and not store.exists("records")
    store.discard({"token_df": store.stage("token_df", rows("c"))})
    store.save("token_df", rows("d"))
    assert store.clean(keep=1) == 2 and [r["token"] for r in store.load("token_df").collect()] == ["d"]
    with pytest.raises(ValueError):
        store.clean(keep=0)


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a-note.md").write_text("---\nstatus: done\nrelates_to: [x:1]\n---\n# Head\nsee [b](sub/b.md#p) and [out](../out.md) and [gone](gone.md)\n")
    (tmp_path / "sub" / "b.md").write_text("no head, back to [a](../a-note.md)")
    (tmp_path / "skip.txt").write_text("no")
    found = {r["path"]: r for r in md.ingest(spark, str(tmp_path), "space").collect()}
    a, b = found["a-note.md"], found["sub/b.md"]
    assert (a["title"], a["content"], a["markers"]) == ("Head", "see [b](sub/b.md#p) and [out](../out.md) and [gone](gone.md)", {"status": ["done"]})
    assert [r["target"] for r in a["relations"]] == ["x:1", b["id"]] and [r["target"] for r in b["relations"]] == [a["id"]]
    assert a["id"] == "src:markdown-space-a-note-md" and b["title"] == "B"
    marks = spark.createDataFrame([(a["url"],)], "source_key string").withColumn("watermark", F.lit("2999-01-01").cast("timestamp"))
    assert [(r["path"], [x["target"] for x in r["relations"]]) for r in md.ingest(spark, str(tmp_path), "space", marks).collect()] == [("sub/b.md", [a["id"]])]


def test_cursors(spark):
    items = spark.createDataFrame([("a", "2024-01-02"), ("a", "2024-01-01"), ("b", None), (None, "2024-01-01")], "k string, e string").withColumn("e", F.col("e").cast("timestamp"))
    marks = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01")], "source_key string, watermark string").withColumn("watermark", F.col("watermark").cast("timestamp"))
    fresh = cu.with_freshness(items, marks, "k", "e")
    assert sorted(r["fresh"] for r in fresh.collect()) == [False, True, True, True]
    assert {str(r["watermark"]) for r in cu.advanced(marks, items, "k", "e").collect()} == {"2024-01-02 00:00:00", "2024-01-01 00:00:00"}
    assert {str(r["watermark"]) for r in cu.floored(marks, "2024-06-01").collect()} == {"2024-06-01 00:00:00"}


def _run(text, **marks):
    return [{"plain_text": text, "annotations": marks}]


def test_pages_to_markdown():
    blocks = [
        {"type": "heading_1", "heading_1": {"rich_text": _run("H")}},
        {"type": "bulleted_list_item", "bulleted_list_item": {"rich_text": _run("a", bold=True, code=True)}},
        {"type": "bulleted_list_item", "bulleted_list_item": {"rich_text": [{"text": {"content": "b", "link": {"url": "u"}}}]}},
        {"type": "to_do", "to_do": {"checked": True, "rich_text": _run("t")}},
        {"type": "code", "code": {"language": "py", "rich_text": _run("x = 1")}},
        {"type": "quote", "quote": {"rich_text": _run("q\n\nr")}},
        {"type": "toggle", "toggle": {"rich_text": _run("s")}, "_children": [{"type": "paragraph", "paragraph": {"rich_text": _run("in")}}]},
        {"type": "callout", "callout": {"rich_text": _run("c"), "icon": {"emoji": "!"}}, "_children": [{"type": "divider"}]},
        {"type": "table", "table": {"table_width": 2, "has_column_header": True}, "_children": [{"type": "table_row", "table_row": {"cells": [_run("a|b"), _run("c")]}}, {"type": "table_row", "table_row": {"cells": [_run("1")]}}]},
        {"type": "link_to_page", "link_to_page": {"type": "page_id", "page_id": "1-2"}},
        {"type": "image", "image": {"type": "external", "external": {"url": "u.png"}, "caption": _run("cap")}},
        {"type": "child_page", "id": "3-4", "child_page": {"title": "Kid"}},
        {"type": "mystery", "mystery": {}},
        {},
    ]
    page = {"id": "aa-bb", "properties": {"Name": {"type": "title", "title": _run("T")}}, "last_edited_time": "2024-01-01T00:00:00.000Z"}
    title, text, meta = bl.page_to_markdown(page, blocks)
    assert title == "T" and meta["page_id"] == "aabb"
    assert text == "# H\n\n- **`a`**\n- [b](u)\n\n- [x] t\n\n```py\nx = 1\n```\n\n> q\n>\n> r\n\n<details><summary>s</summary>\n\nin\n\n</details>\n\n> ! c\n> ---\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n\n[Untitled](notion://12)\n\n![cap](u.png)\n\n- [Kid](notion://34)"


def test_markdown_to_blocks(spark):
    text = "# A\n\n- [x] t\n- [ ] u\n* b\n2. n\n> q\n---\n```sh\nls\n\n# no\n```\nend\n```\nopen"
    rows = spark.createDataFrame([("r", text), ("none", None), ("blank", "  ")], "id string, content string")
    found = [(r["type"], r["text"], r["checked"]) for r in bl.markdown_to_blocks(rows).orderBy("ordinal").collect()]
    assert found == [("heading_1", "A", None), ("to_do", "t", True), ("to_do", "u", False), ("bulleted_list_item", "b", None), ("numbered_list_item", "n", None), ("quote", "q", None), ("divider", "", None), ("code", "ls\n\n# no", None), ("paragraph", "end", None), ("code", "open", None)]


class _Fake:
    made = []

    def list_pages(self, database_id, parent_id, cursor):
        page = lambda n, t: {"id": f"p{n}", "last_edited_time": t, "properties": {"N": {"type": "title", "title": _run(f"T{n}")}}}
        return {"results": [page(1, "2024-01-01T00:00:00Z")], "has_more": True, "next_cursor": "x"} if cursor is None else {"results": [page(2, "2024-01-03T00:00:00Z")], "has_more": False}

    def list_blocks(self, block_id, cursor):
        return {"results": [{"id": "k", "type": "paragraph", "paragraph": {"rich_text": _run(block_id)}}], "has_more": False}

    def create_page(self, parent_id, title, blocks):
        self.made.append((parent_id, title, [b["type"] for b in blocks]))
        return {"id": "new"}

    def update_page(self, page_id, blocks):
        return {}


def test_pull_and_push(spark):
    marks = spark.createDataFrame([("p1", "2024-01-02")], "source_key string, watermark string").withColumn("watermark", F.col("watermark").cast("timestamp"))
    records, after = pg.pull(spark, _Fake, marks, database_id="d")
    found = records.collect()
    assert [(r["id"], r["title"], r["content"]) for r in found] == [("notion:p2", "T2", "p2")]
    assert {r["source_key"] for r in after.collect()} == {"p1", "p2"}
    with pytest.raises(ValueError):
        pg.pull(spark, _Fake, marks)
    plan = spark.createDataFrame([("notion:p2", 0, "create", None, "root", 1), ("z", 1, "skip", None, None, 1)], "id string, ordinal bigint, action string, page_id string, parent_page_id string, revision int")
    assert pg.push(plan, records, _Fake())[0]["page_id"] is None and not _Fake.made
    assert pg.push(plan, records, _Fake(), dry_run=False)[0]["page_id"] == "new" and _Fake.made == [("root", "T2", ["paragraph"])]


def test_workspace(tmp_path):
    with pytest.raises(ws.NotInitialized):
        ws.require_root(tmp_path)
    (tmp_path / "README.md").write_text("# Title\n\n[badge](x)\n\nWhat it is.\nMore.\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("")
    (tmp_path / "node_modules").mkdir()
    ws.init(tmp_path)
    assert ws.init(tmp_path)["already_exists"] and ws.find_root(tmp_path / "src") == tmp_path.resolve()
    assert ws.bootstrap_state(tmp_path) == "needed"
    ws.bootstrap_decision(tmp_path, "declined")
    assert ws.bootstrap_state(tmp_path) == "declined"
    found = ws.skeleton(tmp_path)
    assert found["summary"] == "What it is. More." and found["folders"] == [{"name": "src/", "text": "src: a.py"}]
    assert ws.triggers_push("All DONE now") and ws.triggers_push(command=" git push x") and ws.triggers_push(slash="/ship") and not ws.triggers_push("no")


def test_stream(spark, tmp_path):
    from quillgraph.streaming.ingest import record_stream, start

    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))

    def arrive(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    arrive("1.json", [{"id": "a", "title": "one", "content": "x", "last_edited_time": "2024-01-02T00:00:00Z", "ingest_ordinal": 1}])
    run = lambda: start(record_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck"), AS_OF, once=True).awaitTermination(120)
    run()
    arrive("2.json", [{"id": "a", "title": "late", "content": "x", "last_edited_time": "2024-01-01T00:00:00Z", "ingest_ordinal": 2}, {"id": "b", "title": "two", "content": "y", "ingest_ordinal": 3}])
    run()
    assert {r["id"]: r["title"] for r in store.load("records").collect()} == {"a": "one", "b": "two"}


def test_schema_helpers(spark):
    assert as_records(spark.createDataFrame([], "id string")).schema == spark.createDataFrame([], RECORD).schema
