"""The store: ingestion from every source, changes by difference, layers, writers that compete."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval as rt
from quillgraph.operators.classify import classify
from quillgraph.operators.learning import token_document_frequency
from quillgraph.operators.relations import all_edges, inferred_edges, inferred_near, meeting_keys
from quillgraph.plans.schemas import RECORD, as_records
from quillgraph.sources import blocks as bl
from quillgraph.sources import markdown as md
from quillgraph.sources.store import Conflict, Store, archive, index, remove

AS_OF = "2024-03-01 00:00:00"
EDGE = ["source", "target", "type", "kind", "confidence", "matched_markers", "shared_tokens"]


def table(df, columns=None):
    return sorted(tuple(map(str, r)) for r in df.select(*(columns or df.columns)).collect())


def check_whole(store):
    """Edges, counts and numbers are those of a rebuild."""
    records = store.load("records").cache()
    assert table(store.load("edges"), EDGE) == table(all_edges(records, AS_OF).join(records.select(F.col("id").alias("target")), "target", "left_semi"), EDGE)
    assert table(store.load("token_df"), ["token", "df"]) == table(token_document_frequency(records), ["token", "df"])
    meta = store.current().meta
    assert (meta["records"], meta["edges"]) == (records.count(), store.load("edges").count())
    records.unpersist()


def test_files_are_found_after_indexing(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("---\ntype: rule\nflow: checkout\n---\n# Webhook payments\nretry the deposit callback, see [b](b.md)\n")
    (tmp_path / "notes" / "b.md").write_text("---\ntype: rule\nflow: checkout\n---\n# Second note\nabout refunds\n")
    store = Store(spark, str(tmp_path / "store"))
    assert index(store, md.ingest(spark, str(tmp_path / "notes"), "space"), AS_OF)["records"] == 2
    check_whole(store)
    assert store.load("edges").where("kind = 'explicit'").count() == 1
    found = rt.search(store.load("records"), store.load("edges"), rt.Query.of("deposit callback"), AS_OF).collect()
    assert found[0]["title"] == "Webhook payments" and found[0]["edges"]
    assert sorted(r["ingest_ordinal"] for r in store.load("records").collect())[0] >= 0
    index(store, md.ingest(spark, str(tmp_path / "notes"), "space"), AS_OF)
    assert store.load("records").count() == 2 and store.current().meta["records"] == 2


def test_pages_and_derived_ids_are_indexed_with_edges(spark, tmp_path):
    page = lambda n: json.dumps({"id": f"p-{n}", "last_edited_time": "2024-01-01T00:00:00Z", "properties": {"N": {"type": "title", "title": [{"plain_text": f"webhook checkout {n}"}, "odd run", None]}}})
    store = Store(spark, str(tmp_path))
    pages = spark.createDataFrame([(page(1), "[]"), (page(2), "[]")], "page string, blocks string")
    assert index(store, bl.pages_to_records(pages), AS_OF)["records"] == 2
    plain = spark.createDataFrame([("first webhook note", {"type": ["rule"], "flow": ["checkout"]}), ("second webhook note", {"type": ["rule"], "flow": ["checkout"]})], "title string, markers map<string,array<string>>")
    index(store, plain, AS_OF)
    held = {r["id"] for r in store.load("records").collect()}
    assert {"record:first-webhook-note", "record:second-webhook-note"} < held
    assert store.load("edges").where("source = 'record:first-webhook-note' AND target = 'record:second-webhook-note'").count()
    check_whole(store)


def batch(spark, rng, size, ids):
    flows, artifacts, words = ["checkout", "webhook", "login"], ["webhook", "ui-modal", "checkout"], [f"word{k}" for k in range(30)]
    rows = []
    for k in range(size):
        markers = {n: [rng.choice(v)] for n, v in (("type", ["rule", "bug", "task"]), ("domain", ["payments", "auth"]), ("flow", flows), ("artifact", artifacts)) if rng.random() < 0.6}
        edited = None if rng.random() < 0.2 else f"2024-01-{rng.randrange(1, 28):02d}"
        targets = [{"type": "related_to", "target": f"r{rng.randrange(ids)}", "confidence": 1.0}] if rng.random() < 0.3 else []
        rows.append((f"r{rng.randrange(ids)}", " ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=12)), markers, targets, edited))
    df = spark.createDataFrame(rows, "id string, title string, content string, markers map<string,array<string>>, relations array<struct<type:string,target:string,confidence:double>>, edited string")
    return df.withColumn("last_edited_time", F.try_to_timestamp("edited")).drop("edited")


def test_batches_give_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(5)
    store = Store(spark, str(tmp_path))
    for k in range(4):
        index(store, batch(spark, rng, 12, 40), AS_OF)
        if k == 1:
            gone = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("absent",)], "id string")
            before = store.load("records").count()
            out = remove(store, gone, AS_OF)
            assert out["not_found"] >= 1 and out["records"] == before - (4 - out["not_found"])
        if k == 2:
            some = store.load("records").select("id").limit(2)
            assert archive(store, some, AS_OF, dry_run=True)["changed"] == 2
            assert archive(store, some, AS_OF)["changed"] == 2 and archive(store, some, AS_OF)["changed"] == 0
            assert store.load("records").where("archived").count() == 2
    check_whole(store)
    layers = store.current().tables
    assert all(len(names) <= 5 for names in layers.values())
    sizes = [store.size("records", n) for n in layers["records"]]
    assert all(low >= 2 * sum(sizes[k + 1 :]) for k, low in enumerate(sizes[:-1]))


def test_a_batch_writes_what_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "compact", lambda self, tables=None: 0)  # so small layers would be merged
    store = Store(spark, str(tmp_path))
    rng = random.Random(1)
    index(store, batch(spark, rng, 600, 100_000), AS_OF)
    base = store.current()
    index(store, batch(spark, rng, 1, 100_000), AS_OF)
    after = store.current()
    for name, rows in (("records", 1), ("token_df", 30)):
        assert after.tables[name][:1] == base.tables[name] and len(after.tables[name]) == 2
        assert 0 < store.layer(name, after.tables[name][1]).count() <= rows
        assert store.size(name, after.tables[name][1]) < store.size(name, base.tables[name][0])
    dry = index(store, batch(spark, rng, 1, 100_000), AS_OF, dry_run=True)
    assert dry["dry_run"] and store.current() == after


@pytest.mark.parametrize("limit", [0.3, 0.4])
def test_edges_from_kept_keys(spark, limit):
    own = as_records(classify(batch(spark, random.Random(9), 60, 10_000))).cache()
    kept, dirty = meeting_keys(own, limit), own.where(F.crc32("id") % 3 == 0)
    ids = {r["id"] for r in dirty.collect()}
    want = [r for r in inferred_edges(own, min_score=limit).collect() if r["source"] in ids or r["target"] in ids]
    assert sorted(map(str, inferred_near(dirty, own, kept, limit).collect())) == sorted(map(str, want)) and want
    with pytest.raises(ValueError):
        meeting_keys(own, 0.2)


def test_late_writers_get_a_conflict_or_the_next_number(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, ordinal bigint")
    seen = store.current()
    store.save("outbox", rows("a"))
    assert store.commit({"cursors": store.stage("cursors", spark.createDataFrame([], "source_key string, watermark timestamp"))}, seen=seen).number == 1
    with pytest.raises(Conflict):
        store.save("outbox", rows("b"), seen=seen)
    assert not store._publish(1, "{}") and store.current().number == 1


def test_queues_of_two_writers_lose_nothing(spark, tmp_path):
    from quillgraph.operators.outbox import enqueue

    store, errors = Store(spark, str(tmp_path)), []

    def write(name):
        try:
            for k in range(3):
                store.update("outbox", lambda held: enqueue(held, spark.createDataFrame([(f"{name}{k}", 0)], "id string, ordinal bigint")))  # noqa: B023
        except Exception as error:
            errors.append(error)

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    held = store.load("outbox").collect()
    assert not errors and {r["id"] for r in held} == {f"{n}{k}" for n in "ab" for k in range(3)} and len({r["ordinal"] for r in held}) == 6


def test_streams_without_ordinals(spark, tmp_path):
    from quillgraph.streaming.ingest import record_stream, start

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"id": i, "title": f"note {i}", "content": "x"}) for i in "abc"))
    store = Store(spark, str(tmp_path / "store"))
    start(record_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck"), AS_OF, once=True).awaitTermination(120)
    assert {r["id"] for r in store.load("records").collect()} == set("abc") and store.load("records").schema == spark.createDataFrame([], RECORD).schema
