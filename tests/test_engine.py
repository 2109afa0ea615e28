"""Operators against worked values and against plain sequential versions of the same rule."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import classify as cl
from quillgraph.operators import evaluation as ev
from quillgraph.operators import learning as le
from quillgraph.operators import lifecycle as lc
from quillgraph.operators import outbox as ob
from quillgraph.operators import promotion as pr
from quillgraph.operators import relations as rl
from quillgraph.operators import retrieval as rt
from quillgraph.plans.schemas import RECORD, as_records
from quillgraph.plans.vocabulary import Vocabulary

AS_OF = "2024-03-01 00:00:00"
REC = "id string, title string, content string, markers map<string,array<string>>, relations array<struct<type:string,target:string,confidence:double>>, tokens array<string>, updated_at string, archived boolean, ingest_ordinal bigint"


def records(spark, rows):
    full = [(i, i, i, {k: [v] for k, v in m.items()}, rel, sorted(tok), "2024-03-01", arch, n) for n, (i, m, tok, rel, arch) in enumerate(rows)]
    return spark.createDataFrame(full, REC).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_pair_score(spark):
    a = ("a", {"domain": "payments", "flow": "webhook", "type": "bug"}, ["callback", "deposit", "payment", "webhook", "x"], [], False)
    b = ("b", {"domain": "payments", "flow": "webhook", "type": "rule"}, ["callback", "deposit", "payment", "webhook", "y"], [], False)
    found = rl.inferred_edges(records(spark, [a, b])).orderBy("source").collect()
    assert [(r["source"], r["target"], r["type"], r["confidence"], r["matched_markers"], r["shared_tokens"]) for r in found] == [
        (s, t, "same_pattern_as", 0.425, ["domain", "flow"], ["callback", "deposit", "payment", "webhook"]) for s, t in (("a", "b"), ("b", "a"))
    ]


def _random_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        m = {f: rng.choice(["p", "q", "r"]) for f in ("domain", "flow", "artifact", "type") if rng.random() < 0.8}
        rel = [(rng.choice(["related_to", "fixes"]), f"r{rng.randrange(n + 2)}", 0.5 + rng.randrange(4) / 10) for _ in range(rng.randrange(3))]
        out.append((f"r{k}", m, rng.sample([f"t{i}" for i in range(14)], rng.randrange(12)), rel, False))
    return out


def _score(a, b):
    m = sum(1 for f, v in a[1].items() if b[1].get(f) == v)
    s = 0.5 * (a[1].get("flow", 0) == b[1].get("artifact", 1)) + 0.5 * (a[1].get("artifact", 0) == b[1].get("flow", 1))
    return 0.6 * min(m / 4, 1) + 0.25 * min(len(set(a[2]) & set(b[2])) / 8, 1) + 0.15 * s


@pytest.mark.parametrize("least", [0.3, 0.2])
def test_pruned_pairs_are_all_pairs(spark, least):
    rows = _random_rows(40, 1)
    found = {(r["source"], r["target"]): r["confidence"] for r in rl.inferred_edges(records(spark, rows), min_score=least).collect()}
    want = {(a[0], b[0]): _score(a, b) for a in rows for b in rows if a[0] != b[0] and round(_score(a, b), 3) >= least}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 6e-4 for k in want)


def _edges(df):
    return sorted((r["source"], r["target"], r["type"], r["kind"], r["confidence"]) for r in df.collect())


def test_edges_after_a_delete_are_a_full_rebuild(spark):
    rows = _random_rows(30, 2)
    own = records(spark, rows)
    edges = rl.all_edges(own, AS_OF).cache()
    gone = spark.createDataFrame([("r3",), ("r7",), ("nope",)], "id string")
    left, after, missing = lc.delete(own, edges, gone, "2024-04-01")
    assert [r["id"] for r in missing.collect()] == ["nope"] and left.count() == 28
    whole = rl.all_edges(left, AS_OF).join(left.select(F.col("id").alias("target")), "target", "left_semi")
    assert _edges(after) == _edges(whole)
    kept = after.join(edges.select("source", "target", "type", F.col("updated_at").alias("was")), ["source", "target", "type"])
    assert kept.where("created_at > timestamp '2024-03-02'").isEmpty()  # the age of an edge stays


def test_edges_after_changes_are_a_full_rebuild(spark):
    rows = _random_rows(30, 3)
    edges = rl.all_edges(records(spark, rows), AS_OF).cache()
    changed = [(r[0], {"domain": "p", "flow": "q"}, r[2], r[3], r[4]) if r[0] in ("r1", "r2") else r for r in rows]
    own = records(spark, changed)
    after = rl.edges_around(edges, own, spark.createDataFrame([("r1",), ("r2",)], "id string"), AS_OF)
    whole = rl.all_edges(own, AS_OF).join(own.select(F.col("id").alias("target")), "target", "left_semi")
    before = rl.all_edges(own, AS_OF)
    assert before.count() >= whole.count()
    alive = after.join(own.select(F.col("id").alias("target")), "target", "left_semi")
    assert _edges(alive) == _edges(whole)


def test_classifier_thresholds(spark):
    v = Vocabulary({"domain": ["payments", "auth"]}, {"domain": {"payments": ["billing"]}}, ("domain",), ("domain",))
    rows = [("title", "Billing", "none", ""), ("body", "x", "a billing thing", ""), ("all", "payments", "---\na: payments\n---\n# Metadata\npayments\n# More\ntext", ""), ("none", "", None, "")]
    out = {r["id"]: r for r in cl.classify(spark.createDataFrame(rows, "id string, title string, content string, parent string"), v).collect()}
    assert (out["title"]["arbiter"], out["title"]["markers"]) == ("pending-arbitration", {"domain": ["payments"]})
    assert (out["body"]["arbiter"], out["body"]["markers"], out["body"]["missing_required"]) == ("fallback", {}, ["domain"])
    assert (out["all"]["arbiter"], out["all"]["regions_used"]) == ("deterministic", ["frontmatter", "metadataBlock", "titleText", "body"])
    assert out["none"]["tokens"] == [] and out["none"]["hierarchy"]["path"] == ""
    asked = cl.arbitration_requests(cl.classify(spark.createDataFrame(rows, "id string, title string, content string, parent string"), v), v).collect()
    assert [(r["id"], r["field"], r["allowed_values"]) for r in asked] == [("title", "domain", ["payments", "auth"])]


def test_frequent_tokens_weigh_nothing(spark):
    v = Vocabulary({"domain": ["auth", "data"]}, {}, (), ())
    df = spark.createDataFrame([("auth", 8), ("data", 1), ("x", 2)], "token string, df bigint")
    rows = spark.createDataFrame([("a", "auth data", "", "")], "id string, title string, content string, parent string")
    found = cl.classify(rows, v, df).select(F.inline(F.col("candidates")[0]["candidates"])).collect()
    assert [(r["value"], r["score"], r["matched"]) for r in found] == [("data", 0.2, True), ("auth", 0.0, True)]


def test_search_score(spark):
    row = ("r", {"flow": "webhook", "artifact": "webhook", "domain": "payments", "severity": "high", "status": "done", "type": "rule"}, ["webhook", "retry"], [], False)
    found = rt.scored(records(spark, [row]), rt.Query.of("webhook payment retry"), AS_OF).select("f.*").first()
    assert (found["raw"], found["score"], found["matched_markers"]) == (0.823, 0.823, ["domain", "flow", "artifact"])


def _sequential(rows, query, hops, penalty, own):
    ranked, order = {}, []
    for r in rows:
        if own[r[0]][1]:
            ranked[r[0]] = (own[r[0]][0], 0)
            order.append(r[0])
    by_id, frontier = {r[0]: r for r in rows}, [(i, 0) for i in order]
    for hop in range(1, hops + 1):
        fresh = []
        for seed, _ in frontier:
            for _, target, _ in by_id[seed][3]:
                if target in ranked or target not in by_id:
                    continue
                score = round(max(own[target][0] * penalty ** max(0, hop - 1), ranked[seed][0] * penalty), 3)
                if score > 0:
                    ranked[target] = (score, hop)
                    fresh.append((target, hop))
        frontier = fresh
    return ranked


@pytest.mark.parametrize("seed", range(4))
def test_hops_find_what_the_sequential_rule_finds(spark, seed):
    rows = _random_rows(30, 10 + seed)
    query = rt.Query(text="t1 t2", markers={"domain": "p"}, max_hops=3, hop_penalty=0.7)
    df = records(spark, rows).repartition(3)
    own = {r["id"]: (r["s"], r["relevant"]) for r in rt.scored(df, query, AS_OF).select("id", F.col("f.score").alias("s"), "relevant").collect()}
    found = {r["id"]: (r["score"], r["hop"]) for r in rt.ranked(df, query, AS_OF).collect()}
    want = _sequential(rows, query, 3, 0.7, own)
    assert {k: h for k, (_, h) in found.items()} == {k: h for k, (_, h) in want.items()}
    assert all(abs(found[k][0] - want[k][0]) <= 0.0011 for k in want)


def test_direct_beats_one_hop_beats_two(spark):
    rows = [("a", {"domain": "p"}, ["q"], [("related_to", "b", 1.0)], False), ("b", {}, [], [("related_to", "c", 1.0), ("related_to", "zz", 1.0)], False), ("c", {}, [], [("related_to", "d", 1.0)], False), ("d", {}, [], [], False)]
    found = rt.pack(records(spark, rows), rt.Query(text="q", markers={"domain": "p"}, max_hops=2), AS_OF).orderBy("rank").collect()
    assert [(r["id"], r["hop"]) for r in found] == [("a", 0), ("b", 1), ("c", 2)]
    assert found[0]["score"] > found[1]["score"] > found[2]["score"]


def test_search_hides_archived_and_old_edges(spark):
    rows = [("a", {"domain": "p"}, ["q"], [("fixes", "b", 1.0), ("fixes", "c", 1.0)], False), ("b", {"domain": "p"}, ["q"], [], True), ("c", {"domain": "p"}, ["q"], [], False)]
    own = records(spark, rows)
    edges = rl.all_edges(own, "2024-01-01")
    query = rt.Query(text="q", markers={"domain": "p"})
    found = {r["id"]: r["edges"] for r in rt.search(own, edges, query, AS_OF).collect()}
    assert set(found) == {"a", "c"} and [e["target"] for e in found["a"]] == ["c"]
    assert {r["id"] for r in rt.search(own, edges, rt.Query(text="q", markers={"domain": "p"}, include_archived=True), AS_OF).collect()} == {"a", "b", "c"}
    assert rt.prime(own, edges, AS_OF).isEmpty()


def test_global_rank_is_total(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), "id")
    found = [(r["v"], r["id"]) for r in rt.global_rank(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()]
    assert found == sorted(found, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("seed", range(6))
def test_fold_is_the_sequential_merge(spark, seed):
    rng = random.Random(seed)
    changes = [(f"i{rng.randrange(4)}", n, None if rng.random() < 0.2 else rng.randrange(6)) for n in range(40)]
    before = {f"i{k}": (rng.randrange(6), rng.randrange(1, 4)) for k in range(2)}
    held = {i: (-1, t, v) for i, (t, v) in before.items()}
    for i, n, t in changes:
        if i not in held:
            held[i] = (n, t, 1)
        elif held[i][1] is None or t is None or t >= held[i][1]:
            held[i] = (n, t, held[i][2] + 1)
    previous = spark.createDataFrame([(i, t, v) for i, (t, v) in before.items()], "id string, edited int, version int")
    found = lc.folded(spark.createDataFrame(changes, "id string, ordinal bigint, edited int").repartition(3), previous)
    assert {r["id"]: (r["ordinal"], r["version"]) for r in found.collect()} == {i: (n, v) for i, (n, _, v) in held.items()}


def test_upsert_keeps_archived(spark):
    old = as_records(spark.createDataFrame([("a", "old", True, 3, 0)], "id string, title string, archived boolean, version int, ingest_ordinal bigint"))
    new = as_records(spark.createDataFrame([("a", "new", 5), ("b", "b", 6)], "id string, title string, ingest_ordinal bigint"))
    out = {r["id"]: r for r in lc.upsert(old, new, AS_OF).collect()}
    assert (out["a"]["title"], out["a"]["version"], out["a"]["archived"]) == ("new", 4, True)
    assert out["b"]["version"] == 1


def test_promotion(spark):
    def member(cohort, n, markers, text, tokens=("alpha", "beta")):
        return (cohort, f"{cohort}{n}", n, "T", text, {k: [v] for k, v in markers.items()}, list(tokens))

    rows = [member("c", 1, {"domain": "payments", "flow": "webhook", "type": "bug", "goal": "x", "status": "new"}, "retry the webhook"), member("c", 2, {"domain": "payments", "flow": "webhook", "type": "task", "goal": "y", "status": "new"}, "do not retry the webhook"), member("d", 1, {"domain": "ui", "severity": "low"}, "a"), member("d", 2, {"domain": "ui", "severity": "high"}, "b")]
    own = spark.createDataFrame(rows, "cohort string, id string, ordinal bigint, title string, content string, markers map<string,array<string>>, tokens array<string>")
    quality = {r["cohort"]: r for r in pr.promotion_quality(own).collect()}
    assert (quality["c"]["considered"], quality["c"]["consensus"], quality["c"]["conflicts"], quality["c"]["score"], quality["c"]["recommendation"]) == (5, 3, 2, 0.6, "review")
    assert [(r["cohort"], r["token"], r["affirmative"], r["negated"]) for r in pr.content_conflicts(own).collect()] == [("c", "retry", 1, 1)]
    made = {r["cohort"]: r for r in pr.promote(own).collect()}
    assert set(made) == {"c/affirmative", "c/negated", "d"}
    assert made["d"]["id"] == "promoted:ui-rule" and made["d"]["markers"]["severity"] == ["high"] and made["d"]["markers"]["goal"] == ["prevent-regression"]
    assert [x["target"] for x in made["d"]["relations"]] == ["d1", "d2"]
    whole = pr.promote(own, split=False).where("cohort = 'c'").first()
    assert whole["title"] == "Payments Webhook Rule" and "- type: bug, task" in whole["content"]


def test_mining(spark):
    rows = [(f"r{k}", "", "", "Root > Teams" if k < 4 else "Root", {"status": ["a" if k < 4 else "b"]} if k < 8 else {}, ["body"]) for k in range(10)]
    own = spark.createDataFrame(rows, "id string, title string, content string, parent string, markers map<string,array<string>>, regions_used array<string>")
    assert le.marker_importance(own).first()["importance"] == 0.64
    assert {(r["value"], r["confidence"]) for r in le.mine_hierarchy(own).collect()} == {("teams", round(0.4 * 0.4 + 0.4 * 0.6 + 0.2 * 0.8, 3))}
    proposals = spark.createDataFrame([("pending", "teams", "hierarchy", None, 0.5), ("pending", "x", "ngram", None, 0.5)], "status string, value string, source string, field string, confidence double")
    assert {(r["value"], r["status"], r["field"]) for r in le.decide(proposals, "teams", "accept", "domain").collect()} == {("teams", "accepted", "domain"), ("x", "pending", None)}
    assert le.decide(proposals, "x", "skip").count() == 1
    with pytest.raises(ValueError):
        le.decide(proposals, "x", "accept")


def test_outbox(spark):
    queue = spark.createDataFrame([("a", 0)], "id string, ordinal bigint")
    queue = ob.enqueue(queue, spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "id string, ordinal bigint"))
    assert sorted((r["id"], r["ordinal"]) for r in queue.collect()) == [("a", 0), ("b", 1)]
    state = spark.createDataFrame([], "id string, page_id string, revision int, pushed_at timestamp")
    left, state = ob.apply_results(queue, state, spark.createDataFrame([("a", "p1", 2)], "id string, page_id string, revision int"), AS_OF)
    assert [r["id"] for r in left.collect()] == ["b"] and state.first()["page_id"] == "p1"
    own = as_records(spark.createDataFrame([("a", {"type": ["rule"]}, 2), ("b", {"type": ["rule"], "notionDir": ["adm"]}, 1)], "id string, markers map<string,array<string>>, version int"))
    plan = {r["id"]: (r["action"], r["reason"], r["parent_page_id"]) for r in ob.push_plan(queue, own, state, {"adm/": "P"}, "root").collect()}
    assert plan == {"a": ("skip", "no-revision-change", "root"), "b": ("create", None, "P")}
    assert {r["reason"] for r in ob.push_plan(queue, own, state, {}, None).collect()} == {"no-root-page"}
    files = spark.createDataFrame([("markdown", "/w/docs/a/b.md", "a/b.md"), ("markdown", "/w/docs/sub/c.md", "c.md"), ("other", "/w/docs/sub/x/c.md", "c.md")], "system string, url string, path string")
    assert ob.best_root(files, "/w/docs/sub/x").first()["root"] == "/w/docs/sub"


def test_evaluation(spark):
    queries = spark.createDataFrame([("q", 5), ("none", 5), ("empty", 5)], "query_id string, k int")
    got = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "x", 3), ("none", "a", 1)], "query_id string, id string, rank int")
    want = spark.createDataFrame([("q", "a"), ("q", "b"), ("empty", "z")], "query_id string, id string")
    out = {r["query_id"]: (round(r["precision"], 4), r["recall"]) for r in ev.at_k(got, want, queries).collect()}
    assert out == {"q": (0.6667, 1.0), "none": (1.0, 1.0), "empty": (0.0, 0.0)}
    assert ev.regressed({"mean_precision": 0.6}, {"mean_precision": 0.65}) and not ev.regressed({"mean_precision": 0.6}, {"mean_precision": 0.65}, 0.1)
    assert ev.load_queries('{"version": "1", "queries": [{"id": "a"}]}')[0]["k"] == 5
    with pytest.raises(ValueError):
        ev.load_queries('{"version": "2"}')


def test_empty_tables(spark):
    none = spark.createDataFrame([], RECORD)
    edges = rl.all_edges(none, AS_OF)
    assert edges.isEmpty() and rt.search(none, edges, rt.Query.of("webhook"), AS_OF).isEmpty()
    assert le.full_pass(none)["proposals"].isEmpty() and cl.classify(none).isEmpty()


def test_matched_scores_are_the_matched_ones_of_all(spark):
    """Hits are made once a row; what is left out is only values without hits, and candidates are those of all scores."""
    v = Vocabulary({"domain": ["payments", "auth", "kyc", "ui", "data", "risk", "job"], "type": ["bug", "auth"]}, {"domain": {"payments": ["billing", "auth"]}}, (), ())
    rows = spark.createDataFrame([(1, "billing bug", "auth auth ui-ui kyc", "data"), (2, "", "", ""), (3, "bug", "payments of auth_", "bug")], "id int, title string, content string, parent string")
    found = rows.withColumn("r", cl.regions()).select("id", cl.scores("r", v).alias("s"), cl.matched_scores("r", v).alias("m"))
    found = found.select("*", *[cl.top_candidates("m", n, v).alias(n) for n in v.markers]).collect()
    for r in found:
        assert sorted((x["field"], x["value"], x["score"]) for x in r["m"]) == sorted((x["field"], x["value"], x["score"]) for x in r["s"] if x["matched"])
        for n in v.markers:
            want = sorted((-x["score"], not x["matched"], x["value"]) for x in r["s"] if x["field"] == n)[:5]
            assert [(-c["score"], not c["matched"], c["value"]) for c in r[n]] == want
    assert sum(len(r["m"]) for r in found) > 6


def test_ranks_of_more_rows_than_a_sample(spark):
    """What one use of the ranges counts must be what another numbers; the column that only one of them reads tells them apart."""
    df = spark.range(0, 300_000, 1, 6).select(F.xxhash64("id").alias("h"), F.concat(F.lit("r"), "id").alias("id"), (F.xxhash64("id") % 1000).alias("raw"))
    ranked = rt.global_rank(df, [F.desc("raw"), F.asc("id")]).cache()
    assert [tuple(r) for r in ranked.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).collect()] == [(300_000, 300_000, 1, 300_000)]
    assert ranked.where("rank IN (1, 300000)").orderBy("rank").select("raw").collect()[0][0] == 999
    some = rt.ranks_of(df, df.where("raw % 100 = 7").select("id")).join(ranked.select("id", F.col("rank").alias("want")), "id")
    assert some.count() == df.where("raw % 100 = 7").count() and some.where("rank != want").isEmpty()


def test_rank_places_nulls_as_the_order_does(spark):
    df = spark.createDataFrame([(k, None if k % 3 == 0 else k % 5) for k in range(60)], "id int, v int")
    for order in ([F.desc("v"), F.asc("id")], [F.asc("v"), F.desc("id")]):
        assert [r["id"] for r in rt.global_rank(df, order).orderBy("rank").collect()] == [r["id"] for r in df.orderBy(*order).collect()]


def test_alike_records_are_compared_once(spark):
    """Copies of a record have the edges of their kind, also with one another, and what kinds are counted by is what the edges give."""
    rows = _random_rows(14, 3)
    copies = records(spark, [(f"{r[0]}-{k}", r[1], r[2], [], False) for r in rows for k in range(1 + len(r[2]) % 4)])
    found = {(r["source"], r["target"]): r["confidence"] for r in rl.inferred_edges(copies).collect()}
    of = {r["id"]: dict(r["markers"]) for r in copies.collect()}
    plain = {f"{r[0]}-{k}": r for r in rows for k in range(1 + len(r[2]) % 4)}
    want = {(a, b): _score(plain[a], plain[b]) for a in of for b in of if a != b and round(_score(plain[a], plain[b]), 3) >= 0.3}
    assert set(found) == set(want) and len(want) > 100
    counted = {r["type"]: (r["n"], round(r["mean_confidence"], 6)) for r in rl.inferred_types(copies).collect()}
    assert counted == {r["type"]: (r["n"], round(r["m"], 6)) for r in rl.inferred_edges(copies).groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("m")).collect()}
    assert rl._kinds(rl._with_kind(copies)).count() <= len(rows)


def test_omitted_count_ranks_once(spark):
    own = records(spark, [(f"r{k}", {"domain": "p"}, ["q"], [], False) for k in range(30)])
    query = rt.Query(text="q", markers={"domain": "p"}, max_hops=0)
    counted, ranked = rt.omitted_count(own, query, AS_OF), rt.ranked(own, query, AS_OF)
    made = [d._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") for d in (counted, ranked)]
    assert made[0] == made[1] == 1 and counted.collect()[0][0] == 30 - 13


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_conflicts_are_dealt_once(spark):
    """Members are exploded and counted once: conflicts take one exchange, suggestions one for each of their three keys."""
    rows = [("c", f"m{k}", k, {"type": ["a", "b", "c"][k % 3 : k % 3 + 1], "goal": ["x"], "status": ["s", "t"] if k % 2 else ["u"], "zone": []}) for k in range(6)]
    members = spark.createDataFrame([*rows, ("d", "m9", 9, {"type": ["a"]})], "cohort string, id string, ordinal bigint, markers map<string,array<string>>")
    conflicts, found = pr.marker_conflicts(members), pr.split_suggestions(members)
    assert _exchanges(conflicts) == 1 and _exchanges(found) == 3
    assert sorted(map(tuple, conflicts.collect())) == [("c", "status", ["s, t", "u"]), ("c", "type", ["a", "b", "c"])]
    assert sorted(map(tuple, found.collect())) == [("c", "status", 2, "s, t", 3, 1), ("c", "status", 2, "u", 3, 2), *[("c", "type", 1, v, 2, k) for k, v in enumerate("abc", 1)]]
    assert sorted(map(tuple, pr.marker_conflicts(members, pr.field_values(members)).collect())) == sorted(map(tuple, conflicts.collect()))


def test_edges_of_long_records(spark):
    """Matched markers, shared tokens and types of records with many fields and tokens, and of more alike ones than a unit has."""
    rng = random.Random(5)
    fields = ["domain", "flow", "artifact", *(f"f{k}" for k in range(8))]
    rows = [(f"r{k}", {f: rng.choice("pqrs") for f in fields if rng.random() < 0.5}, rng.sample([f"t{i:02}" for i in range(30)], rng.randrange(2, 20)), [], False) for k in range(25)]
    found = {(r["source"], r["target"]): (r["type"], r["matched_markers"], r["shared_tokens"]) for r in rl.inferred_edges(records(spark, rows)).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a is not b and round(_score(a, b), 3) >= 0.3:
                same = sorted(f for f in a[1] if b[1].get(f) == a[1][f])
                kind = "same_pattern_as" if {"domain", "flow"} <= set(same) else "might_affect" if {"flow", "artifact"} & set(same) else "related_pattern"
                want[a[0], b[0]] = (kind, same, sorted(set(a[2]) & set(b[2]))[:12])
    assert found == want and max(len(v[1]) for v in want.values()) > 2
    alike = records(spark, [(f"r{k}", {"domain": "p", "type": "q"}, ["x"], [], False) for k in range(3 * rl.UNIT)])
    assert max(len(r["members"]) for r in rl._units(alike).collect()) < 1.5 * rl.UNIT
    made = rl.inferred_edges(alike).agg(F.count("*"), F.count_distinct("source", "target"), F.count_if(F.col("source") == F.col("target"))).first()
    assert tuple(made) == (3 * rl.UNIT * (3 * rl.UNIT - 1),) * 2 + (0,)


def test_tokens_are_rare_within_a_marker(spark):
    """A token that all records of a domain have isn't what its records meet under, though it is rare among all records."""
    rows = [(f"r{k}", {"domain": f"d{k % 3}"}, [f"d{k % 3}", *(f"t{(k // 3 + j) % 8}" for j in range(5))], [], False) for k in range(24)]
    units = rl._numbered(rl._kinds(rl._with_kind(records(spark, rows))))
    met = rl._token_meetings(units, None, 0.3)[0]
    own = units.select("unit", F.xxhash64(F.lit(10), F.get("marked", F.lit(0)), F.xxhash64(F.get("tokens", F.lit(0)))).alias("k"))
    assert not met.isEmpty() and met.join(own, ["unit", "k"]).isEmpty()
    found = {(r["source"], r["target"]) for r in rl.inferred_edges(records(spark, rows)).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in rows if a is not b and round(_score(a, b), 3) >= 0.3} and found


def test_explicit_edges_cover_without_a_join(spark):
    """An explicit edge of an inferred type takes the place of the inferred one in its direction alone, and inferred edges aren't joined with explicit ones."""
    rows = [(f"r{k}", {"domain": "p", "type": "q"}, ["x"], [("related_pattern", "r1", 0.7), (None, "r2", None), ("related_pattern", "", 1.0)] if k == 0 else [], False) for k in range(3)]
    edges = rl.all_edges(records(spark, rows), AS_OF)
    assert "LeftAnti" not in edges._jdf.queryExecution().optimizedPlan().toString()
    made = [(r["source"], r["target"], r["type"], r["kind"]) for r in edges.collect()]
    pairs = [(f"r{a}", f"r{b}") for a in range(3) for b in range(3) if a != b]
    assert sorted(made) == sorted([("r0", "r1", "related_pattern", "explicit"), ("r0", "r2", "related_to", "explicit"), *[(a, b, "related_pattern", "inferred") for a, b in pairs if (a, b) != ("r0", "r1")]])


def test_delete_reads_what_lives_from_a_written_table(spark):
    """Edges are joined with a table of known size on both ends, so where it is small they aren't shuffled; dangling ones go as well."""
    rows = [(f"r{k}", {"domain": "p", "type": "q"}, ["x"], [("fixes", "nowhere", 1.0)] if k == 0 else [], False) for k in range(4)]
    own = records(spark, rows)
    after = lc.delete(own, rl.all_edges(own, AS_OF), spark.createDataFrame([("r1",)], "id string"), AS_OF)[1]
    assert sum("/living-" in f for f in after.inputFiles()) > 0
    ends = sorted((r["source"], r["target"]) for r in after.collect())
    assert ends == [(f"r{a}", f"r{b}") for a in (0, 2, 3) for b in (0, 2, 3) if a != b]


def _top_rows(n, seed):
    """Some records with more explicit edges than the limit, some with fewer, some of types that inferred edges have."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        m = {f: rng.choice("pq") for f in ("domain", "flow", "artifact", "type")}
        rel = [(rng.choice(["related_to", "might_affect", "same_pattern_as", None]), rng.choice([f"r{rng.randrange(n)}", "", None, "zz"]), rng.choice([None, 0.5, 0.9])) for _ in range(rng.choice([0, 1, 3, 12]))]
        out.append((f"r{k}", m, rng.sample([f"t{i}" for i in range(9)], 5), rel, False))
    return out


def test_top_edges_are_the_first_of_all(spark):
    own = records(spark, _top_rows(30, 4))
    want = rl.outgoing(rl.all_edges(own, AS_OF), 4).select("source", "target", "type", "kind", "confidence", "rank")
    top = rl.top_edges(own, 4)
    assert top.columns == want.columns and sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))
    assert top.where("kind = 'explicit'").count() > 20 and top.where("kind = 'inferred'").count() > 20
    few = records(spark, [(f"r{k}", {"domain": "p", "type": "q"}, ["x"], [("fixes", f"r{j}", 1.0) for j in range(4)], False) for k in range(9)])
    assert rl.top_edges(few, 4).count() == 36 and rl.top_edges(few, 4).where("kind = 'inferred'").isEmpty()
