"""Streams with state: batches cut anyhow, with restarts, give what a table gives."""

import json
import random

from pyspark.sql import functions as F

from quillgraph.operators.lifecycle import folded
from quillgraph.streaming.state import edge_life, held_stream


def run(spark, stream, folder, name):
    """Runs what has arrived and stops; the checkpoint carries the state to the next run."""
    path = f"{folder}/{name}-out"
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(path)).option("checkpointLocation", f"{folder}/{name}-ck").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(path)


def test_changes_fold_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    changes = [{"id": f"u{rng.randrange(6)}", "ordinal": k, "edited": None if rng.random() < 0.15 else f"2024-01-{rng.randrange(1, 28):02d}T00:00:00Z"} for k in range(80)]
    (tmp_path / "in").mkdir()
    schema = "id string, ordinal bigint, edited timestamp"
    for n, (a, b) in enumerate(((0, 30), (30, 31), (31, 80))):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, changes[a:b])))
        out = run(spark, held_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))), tmp_path, "held")
    last = {r["id"]: (r["ordinal"], r["version"]) for r in out.groupBy("id").agg(F.max_by("ordinal", "version").alias("ordinal"), F.max("version").alias("version")).collect()}
    want = {r["id"]: (r["ordinal"], r["version"]) for r in folded(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    assert last == want and len(want) == 6


def test_edges_expire_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "source string, target string, type string, kind string, created_at timestamp"
    edge = lambda s, kind, day: {"source": s, "target": "t", "type": "x", "kind": kind, "created_at": day and f"{day}T00:00:00Z"}
    batches = [[edge("a", "inferred", "2024-01-01"), edge("b", "inferred", "2024-01-20"), edge("c", "explicit", "2024-01-01"), edge("d", "inferred", None)], [edge("a", "inferred", "2024-01-25"), edge("a", "inferred", "2024-01-02"), edge("e", "inferred", "2024-02-09")], [edge("f", "inferred", "2024-02-10")], [edge("g", "inferred", "2024-03-30")], [edge("h", "inferred", "2024-03-31")]]
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        out = run(spark, edge_life(spark.readStream.schema(schema).json(str(tmp_path / "in"))), tmp_path, "life")
    found = sorted((r["source"], r["state"], str(r["created_at"])[:10]) for r in out.collect())
    assert [f for f in found if f[1] == "expired"] == [("a", "expired", "2024-01-25"), ("b", "expired", "2024-01-20"), ("e", "expired", "2024-02-09"), ("f", "expired", "2024-02-10")]
    assert [f[0] for f in found if f[1] == "alive"] == ["a", "a", "b", "c", "d", "e", "f", "g", "h"]
