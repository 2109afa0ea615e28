"""Text, time, vocabulary and intents against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import timeutil as tm
from quillgraph.plans.intents import PRESETS, resolve
from quillgraph.plans.vocabulary import Vocabulary, merged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(text):
    return F.lit(text)


def test_slugs_and_tokens(spark):
    assert one(spark, tx.slugify(lit("  Foo_Bar -- baz! "))) == "foo-bar-baz"
    assert one(spark, tx.tokenize(lit("Retry-safe, a RETRY of x2 x2"))) == ["of", "retry", "retry-safe", "x2"]
    assert one(spark, tx.tokenize(lit(""))) == []
    assert one(spark, tx.slugify(F.lit(None).cast("string"))) is None


def test_negation_reaches_the_next_content_word(spark):
    def negated(text):
        return [r["token"] for r in one(spark, tx.negation_tokens(lit(text))) if r["negated"]]

    assert negated("do not retry the webhook") == ["retry"]
    assert negated("never the webhook") == ["webhook"]
    assert negated("don't stop retry") == ["retry"]
    assert negated("") == []


def test_front_matter(spark):
    text = "---\ntitle: 'A b'\n# no\ntags: [x, \"y z\"]\nempty: []\ndone: TRUE\ntags2:\ntitle: last\n---\nbody\n# Head \nmore"
    found = one(spark, tx.front_matter(lit(text)))
    assert found == {"tags": ["x", "y z"], "empty": [], "done": ["true"], "tags2": [""], "title": ["last"]}
    body = one(spark, tx.without_front_matter(lit(text)))
    assert body == "body\n# Head \nmore"
    assert one(spark, tx.title_of(lit(body), lit("f"))) == "Head"
    assert one(spark, tx.content_of(lit(body))) == "body\n\nmore"
    assert one(spark, tx.title_of(lit("no head"), lit("f"))) == "f"
    assert one(spark, tx.front_matter(lit("plain"))) == {}


def test_files_and_links(spark):
    assert one(spark, tx.title_from_filename(lit("my-note_two 0123456789abcdef0123456789abcdef"))) == "My Note Two"
    assert one(spark, tx.page_id(lit("x 0123456789ABCDEF0123456789abcdef"))) == "0123456789abcdef0123456789abcdef"
    assert one(spark, tx.page_id(lit("x"))) is None
    assert one(spark, tx.link_targets(lit("[a](b.md#c) [d](https://e/f.md) [g](h%20i.md) [j](#k) [l](a+b.md)"))) == ["b.md", "h i.md", "a+b.md"]
    assert one(spark, tx.markdown_to_text(lit("[a](b.md) ``c``"))) == "a c"


def test_redaction_keeps_its_order(spark):
    assert one(spark, tx.strip_secrets(lit("me@a.com sk-abcdefghijklmnopqrst"))) == "[redacted-email] [redacted-secret]"
    tx.register_redactor(F.upper)
    tx.register_redactor(lambda c: F.concat(c, F.lit("!")))
    assert one(spark, tx.redacted(lit("a"))) == "A!"
    tx.clear_redactors()
    assert one(spark, tx.redacted(lit("a"))) == "a"


def test_decay(spark):
    def at(days, kind):
        stamp = F.expr(f"timestamp '2024-03-01' - interval {days} days")
        return one(spark, F.round(tm.freshness(F.lit(kind), stamp, "2024-03-01"), 6))

    assert (at(60, "task"), at(365, "rule"), at(60, "unknown"), at(-5, "task")) == (0.25, 0.5, 0.5, 1.0)
    assert one(spark, tm.freshness(F.lit("task"), F.lit(None).cast("timestamp"), "2024-03-01")) == 1.0
    assert one(spark, tm.recency(F.lit(None).cast("timestamp"), "2024-03-01")) == 0.0
    assert one(spark, tm.parsed(lit("junk"))) is None and one(spark, tm.parsed(lit("2024-01-01T00:00:00.000Z"))) is not None
    assert [one(spark, tm.hop_penalized(F.lit(0.8), h, 0.5)) for h in (0, 1, 2)] == [0.8, 0.8, 0.4]
    assert one(spark, tm.hop_penalized(F.lit(0.8), 3, 0)) == 0.8


def test_query_signals_and_hashtags():
    v = Vocabulary()
    assert v.query_markers("webhook payment retry") == {"domain": "payments", "flow": "webhook", "artifact": "webhook"}
    assert v.query_markers("x", {"status": "WIP", "goal": ""}) == {"status": "in-progress"}
    assert v.hashtags("#bug #task #nope a") == ({"type": "task"}, ["nope"], "#nope a")
    assert v.normalize("status", "Open Risk") == "known-risk" and v.normalize("room", "My Room") == "my-room"


def test_merged_vocabulary():
    own = merged(Vocabulary(), {"aliases": {"domain": {"payments": ["cash"]}}, "hierarchy": {"preferredOrder": ["flow"]}}, {"domain": ["lending"]}, {"domain": ["ui"]})
    assert own.markers["domain"][-1] == "lending" and "ui" not in own.markers["domain"]
    assert own.aliases["domain"]["payments"][-1] == "cash" and own.hierarchy == ("flow",)


def test_intents():
    assert resolve() is None
    assert resolve("debug", {"set": {"hop_cap": 5}}).setting("hop_cap") == 5 and PRESETS["debug"].setting("hop_cap") == 2
    own = resolve("debug", {"set": {"hop_cap": 5}, "type": {"rule": 2.0}})
    assert own.setting("freshness") == 1.5 and own.table("type") == {"rule": 2.0} and list(own.table("relation")) == ["might_affect", "same_pattern_as"]
    with pytest.raises(ValueError):
        resolve("nope")
