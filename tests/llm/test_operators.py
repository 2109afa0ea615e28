"""Each operator against brute force, round trips or held-out text, and on hard tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import database, rows
from conftest import SMALL
from quillgraph.llm import components as cc
from quillgraph.llm import crosstok, decontam, fmindex, lexical, lm, mixing, neardup, pii, quality, queries, ranking, substring, tables, tokencount, urlfilter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, _row string, _counts string, _kept string, _hits string, _topic string"
HARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (None, "two words", "en", "s", 9), (5, "x" * 300_000, "xx", "s", 1), (6, "a b c d e " * 20_000, "en", None, 1), (7, "a b c d e " * 20_000, "en", None, 1)]


@pytest.fixture(scope="module")
def documents(spark):
    return tables.read(spark, SMALL, "documents").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in HARD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# 1


def counted(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts(documents, texts):
    for r in quality.op1_quality_rules(documents).collect():
        want = counted(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark, documents):
    found = quality.op1_quality_rules(documents).join(tables.read(spark, SMALL, "labels").withColumnRenamed("quality", "label"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in found if r["label"] == 1]
    bad = [r["kept"] for r in found if r["label"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_estimate_finds_the_better_rule():
    rng = random.Random(0)
    patterns = collections.Counter()
    for _ in range(20_000):
        y = rng.random() < 0.8
        vote = lambda right: (1 if y else -1) if rng.random() < right else (-1 if y else 1)
        patterns[tuple(vote(p) if rng.random() < 0.9 else 0 for p in (0.95, 0.9, 0.9, 0.7))] += 1
    found = quality.estimate(list(patterns.items()), ["form"] * 4)
    assert found.right()[0] > 0.9 > 0.8 > found.right()[3] and 0.7 < found.prior < 0.9
    assert quality.estimate([], ["form"] * 2).prior == 0.8


def test_quality_hard(hard, none):
    found = quality.op1_quality_rules(hard).collect()
    assert len(found) == len(HARD) and quality.op1_quality_rules(none).isEmpty()
    assert next(r for r in found if r["doc_id"] == 1)["n_words"] == 0
    assert quality.kept(hard).columns == hard.columns and quality.kept(none).isEmpty()


# 2

_BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, pattern in _BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if good else []
    return ",".join(out)


def test_pii_base(documents, texts):
    for r in pii.op2_pii_anchors(documents).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(texts[r["doc_id"]]).encode()).hexdigest()


def test_pii_base_on_odd_texts():
    rng, automaton = random.Random(5), pii._automaton()
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b.", "@", "1", "12", "255", ".", ".", "+", "+1", " ", "-", "(", "é", "4242424242424242", "%"]) for _ in range(rng.randrange(25)))
        assert pii.joined([x for x in pii.find(text, automaton) if x[0] in pii.BASE]) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("pay account no: 12345678 now", "pay account no: [ACCOUNT] now"),
        ("IBAN DE89 3704 0044 0532 0130 00 x", "IBAN [ACCOUNT] x"),
        ("IBAN DE88370400440532013000x", "IBAN [ACCOUNT]"),
        ("at 12 Old Mill Road, here", "at [ADDRESS], here"),
        ("see https://bob:pw@host.com/x y", "see [ADDRESS] y"),
        ("see https://host.com/x y", "see https://host.com/x y"),
        ('token = "0cab398dc11d1a2a" x', 'token = "[ACCOUNT]" x'),
        ("the account of 1990 was", "the account of 1990 was"),
        ("mail a@b.co, call +1 (555) 555-1234", "mail [EMAIL], call [PHONE]"),
    ],
)
def test_pii_method(text, masked):
    assert pii.mask(text, pii.find(text, pii._automaton())) == masked


def test_pii_hard(hard, none):
    found = pii.op2_pii_anchors(hard).collect()
    assert len(found) == len(HARD) and all(r["spans"] == "" for r in found) and pii.op2_pii_anchors(none).isEmpty()
    assert [r[0] for r in hard.select(pii.masked("text")).collect()] == [r[1] for r in HARD]


# 3


def test_warc_round_trip(spark, tmp_path):
    pages = tables.read(spark, SMALL, "pages").limit(10)
    source = warc.responses(pages)
    made = warc.derived(source)
    for name, zipped in (("a.warc.gz", True), ("b.warc", False)):
        (tmp_path / name).write_bytes(b"".join(r[0] for r in source.unionByName(made).select(warc.file_bytes(zipped=zipped)).collect()))
    back = warc.read_warc(spark, str(tmp_path))
    assert back.count() == 2 * 3 * 10 and back.where("truncated").isEmpty()
    digests = collections.Counter(r[0] for r in back.select(F.md5("block")).collect())
    assert digests == collections.Counter(r[0] for r in source.unionByName(made).unionByName(source).unionByName(made).select(F.md5("block")).collect())
    ids = {r["headers"]["WARC-Record-ID"]: r for r in source.collect()}
    for r in made.collect():
        of = ids[r["headers"]["WARC-Refers-To"]]
        assert r["headers"]["WARC-Target-URI"] == of["headers"]["WARC-Target-URI"] and r["headers"]["WARC-Block-Digest"] == warc.digest(r["block"])
        if r["headers"]["WARC-Type"] == "metadata":
            assert f"source-payload-digest: {of['headers']['WARC-Payload-Digest']}" in r["block"].decode()


def test_warc_odd_responses():
    import gzip

    body = "<html lang=fr><title>A &amp; B</title><body>x<!-- <p>no --><script>var a = '</p>'</script><p>é &#8217;</p><td>1<td>2<a href='/z y'>l</a>".encode()
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    for head, payload in ((b"Content-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked", chunked), (b"Content-Encoding: gzip", gzip.compress(body))):
        block = b"HTTP/1.1 404 Not Found\r\nX-A: b\r\n c\r\n" + head + b"\r\n\r\n" + payload
        meta, text = warc.derivatives(warc.Record({"WARC-Record-ID": "<i>", "WARC-Target-URI": "u"}, block))
        assert text.block.decode() == "A & B\nx\né ’\n1 2l"
        fields = meta.block.decode()
        assert "http-status: 404" in fields and "http-header-x-a: b c" in fields and "outlink: /z%20y a/@href" in fields and "language: fr" in fields
    assert warc.plain_text("") == "" and warc.derivatives(warc.Record({}, b""))[1].block == b""
    cut = warc.Record({"WARC-Type": "response"}, b"abcdef").to_bytes()[:-6]
    assert [(r.block, r.truncated) for r in warc.parse(cut)] == [(b"abcd", True)]
    assert list(warc.parse(b"")) == []


def test_warc_query(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>")], "page_id bigint, url string, html string")
    found = warc.op3_warc_derivatives(pages).collect()
    assert len(found) == 6 and [r["content"] for r in found if r["page_id"] == 2 and r["record_type"] == "conversion"] == ["a", "a"]
    assert warc.op3_warc_derivatives(pages.limit(0)).isEmpty()


# 4


def test_model_counts_and_held_out_text(documents, texts):
    found = lm.scores(documents, model_words=200, head_words=1000).collect()
    tokens = {d: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + ["<end>"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in found:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    own = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) * 1.02


def test_model_learns_an_order_and_is_normalised():
    rng = np.random.default_rng(0)
    seq = np.tile(np.array([1, 2, 3]), 20_000).astype(np.int32)
    noise = np.bincount(seq, minlength=4).astype(float)
    model = lm.Model(4, noise)
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    for state in [{}] * 8:
        model.train(seq, one, two, state)
    first, second, log_sum = model.tables()
    p = np.exp(first[:, None, :] + second[None, :, :] - log_sum[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4) and p[1, 3, 2] > 0.8 and p[2, 1, 3] > 0.8
    assert rng is not None


def test_frequent_outcomes_have_small_classes():
    size = 20_000
    model = lm.Model(size, 1e6 / np.arange(1, size + 1))
    sizes = np.diff(model.bounds)
    assert sizes.min() > 0 and sizes.sum() == size and np.array_equal(np.repeat(np.arange(len(sizes)), sizes), model.class_of)
    assert len(sizes) + (model.noise * sizes[model.class_of]).sum() < 0.75 * 2 * math.sqrt(size)  # scores a token
    assert len(lm.Model(10_000, np.ones(10_000)).bounds) in range(100, 104) and len(lm.Model(500, np.ones(500)).bounds) == 2


def test_model_hard(hard, none):
    found = {r["doc_id"]: r for r in lm.scores(hard).collect() if r["doc_id"] in (1, 2, 6)}
    assert found[1]["n_tokens"] == found[2]["n_tokens"] == 1 and found[6]["n_tokens"] == 100_001
    assert all(math.isfinite(r["score"]) for r in found.values()) and lm.scores(none).isEmpty()


# 5


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return tokencount.tokenizer(public_tokenizers.path(tokencount.VOCABULARY))


def test_token_counts(documents, texts, model):
    for r in tokencount.op5_token_counts(documents).collect():
        text = texts[r["doc_id"]]
        n = len(model.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_token_counts_on_odd_texts(model):
    rng, sizes = random.Random(2), tokencount.WordSizes(model)
    parts = ["a", "the ", "É", "\u0301", " ", "\n", "\x85", "\u3000", "<|endoftext|>", "'s", "12", "ß", "Σς ", "!!", "😀", "x" * 50]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        n = len(model.encode(text, add_special_tokens=False).ids)
        assert tokencount.count_long(model.encode, text, rng.choice([20, 40]), rng.choice([4, 16])) == n == sizes.totals(pa.array([text]))[0]


def test_token_counts_hard(hard, none, model):
    found = sorted((r["n_bytes"], r["n_tokens"]) for r in tokencount.op5_token_counts(hard).collect())
    assert found == sorted((len((r[1] or "").encode()), len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in HARD)
    assert tokencount.op5_token_counts(none).isEmpty()


# 6


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(100):
        size = int(rng.integers(1, 5))
        s = rng.integers(0, size + 1, int(rng.integers(1, 120)))
        s[-1] = 0
        index = fmindex.FMIndex(s, size + 1, step=4)
        for length in (1, 2, 4):
            phrases = rng.integers(1, size + 1, (5, length))
            for p, a, b in zip(phrases, *index.search(phrases)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - length + 1) if (s[i : i + length] == p).all()]


def test_decontamination_in_blocks(spark, documents):
    bench = tables.read(spark, SMALL, "benchmark")
    want = rows(database(SMALL).execute(decontam.ORACLE).df())
    assert rows(decontam.op6_benchmark_decontamination(documents, bench).toPandas()) == want
    split = decontam.with_hits(documents, bench, limit=200)
    again = split.select("doc_id", decontam.n_hit().alias("n"), F.size("_hits.items").alias("i")).exceptAll(decontam.with_hits(documents, bench).select("doc_id", decontam.n_hit().alias("n"), F.size("_hits.items").alias("i")))
    assert again.isEmpty() and len(list(decontam.blocks(bench, 200))) > 1


def test_decontamination_hard(spark, hard, none):
    bench = spark.createDataFrame([(1, "ONE"), (1, "one"), (None, "two"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(14)))], "item_id bigint, text string")
    extra = hard.unionByName(spark.createDataFrame([(9, " ".join(f"W{i}," for i in range(1, 14)), "", "", 1, *[""] * 6)], DOCS))
    found = {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.op6_benchmark_decontamination(extra, bench).collect()}
    assert {(4, 1, 1, True), (None, 1, 0, True), (1, 0, 0, False), (9, 13, 1, True), (6, 0, 0, False)} <= found
    assert decontam.op6_benchmark_decontamination(none, bench).isEmpty()
    assert decontam.clean(hard, bench.limit(0)).count() == len(HARD)


# 7


def test_mixture_sql(spark):
    assert rows(mixing.op7_ipf_mixing(tables.read(spark, SMALL, "documents")).toPandas()) == rows(database(SMALL).execute(mixing.ORACLE).df())


def test_raking_reaches_its_marginals():
    t = np.array([[[10.0, 5], [1, 4]], [[100, 3], [8, 0]]])
    targets = [{"a": 0.5, "b": 0.5}, {"x": 0.3, "y": 0.7}, {"u": 0.6, "v": 0.4}]
    names = [["a", "b"], ["x", "y"], ["u", "v"]]
    f = mixing.fit(t, targets, names, 300, 0.05) / (0.05 * t.sum())
    assert np.allclose(f.sum(axis=(1, 2)), [0.5, 0.5]) and np.allclose(f.sum(axis=(0, 2)), [0.3, 0.7]) and np.allclose(f.sum(axis=(0, 1)), [0.6, 0.4])
    assert f[1, 1, 1] == 0
    whole = mixing.fit(t, targets, names, 300, 1.0)
    assert (whole <= t + 1e-9).all() and np.allclose(whole[0, 1], t[0, 1]) and whole.sum() > 0.2 * t.sum()


def test_rare_values_do_not_thin_out_the_rest(spark):
    docs = spark.createDataFrame([(d, "a b c d " * 20 if d else "a | b", "en", f"src{d % 20}", 1, *[""] * 6) for d in range(2000)], DOCS)
    assert mixing.sampled(docs).count() > 1000


def test_mixture_hard(hard, none):
    found = mixing.op7_ipf_mixing(hard).collect()
    assert len(found) == len(HARD) and {r["source"] for r in found} == {"other"} and mixing.op7_ipf_mixing(none).isEmpty()
    assert mixing.sampled(hard).columns == [*hard.columns, "mix_probability"]


# 8


def test_url_rules(spark):
    pages = tables.read(spark, SMALL, "pages")
    extra = spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, "HTTP://X.ORG?a", ""), (-4, "s://b.EXAMPLE.org/es/q?x#y", ""), (-5, "nothing", ""), (-6, "s://xorg/", ""), (-7, "s://org/", "")], "page_id bigint, url string, html string")
    own = pages.select("page_id", "url", "html").unionByName(extra)
    urls = {r["page_id"]: r["url"] for r in own.collect()}
    for r in urlfilter.op8_url_ratio(own).collect():
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [x for x in urlfilter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "allow" if r["probability"] >= 0.5 else "block")
    assert urlfilter.op8_url_ratio(own.limit(0)).isEmpty()


def test_url_model_tells_unseen_urls():
    rng = random.Random(3)
    good = [f"https://news{rng.randrange(999)}.example/story/{rng.randrange(9999)}" for _ in range(400)]
    bad = [f"http://cheap-pills{rng.randrange(999)}.example/buy?id={rng.randrange(9999)}" for _ in range(400)]
    ratio = urlfilter.fit(good[:300], bad[:300])
    p = ratio.probability(ratio.ratios(pa.array(good[300:] + bad[300:])))
    assert (p[:100] > 0.5).mean() > 0.98 and (p[100:] < 0.5).mean() > 0.98
    assert urlfilter.fit([], bad) is None and ratio.ratios(pa.array(["", None]))[0] == 0


def test_markov_is_a_distribution():
    model = urlfilter.Markov(["abcab", "abd"], 2)
    tails = [math.exp(x) for x in model.log_likelihoods(pa.array([bytes([b]).decode("latin-1") for b in range(128)]))]
    assert sum(tails) < 1 and tails[ord("a")] > 0.5


# 9


def edits(a, b):
    """Plain edit distance, a row of costs at a time."""
    number = {w: k for k, w in enumerate({*a, *b})}
    a, b = (np.array([number[w] for w in x], int) for x in (a, b))
    places = np.arange(len(b) + 1)
    row = places
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - places) + places
    return int(row[-1])


def edit_similarity(a, b):
    longer = max(len(a), len(b))
    common = sum((collections.Counter(a) & collections.Counter(b)).values())
    return 1 - edits(a, b) / longer if longer and common >= 0.8 * longer else 0


def _pairs(texts, least=0.8):
    own = {d: words(t) for d, t in texts.items() if t}
    return [(a, b) for a in own for b in own if a < b and edit_similarity(own[a], own[b]) >= least - 1e-9]


def _near_copies(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = {}
    for d in range(120):  # a star of near copies, many of which aren't alike themselves
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        out[d] = " ".join(w)
    for d in range(200, 260):  # unrelated, but for a common passage
        out[d] = " ".join([*base[:40], *(f"u{d}x{k}" for k in range(60))])
    out |= {300: "a b c d e f g h", 301: "a b c d e f g h i", 302: "a b c d", 303: "a b c d", 304: "a b c", 305: out[3] + " "}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_are_all_found(spark, seed):
    texts = _near_copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.op9_order_minhash(docs).collect()}
    assert all(found[a] == found[b] for a, b in _pairs(texts))
    near = _pairs(texts)
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert all(found[d] == top(d) for d in texts)


def _edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(4)
        text[at : at + (kind != 0)] = [] if kind == 1 else [f"z{rng.randrange(10**9)}"]
    return text


@pytest.mark.parametrize("kind", ["few words", "many words"])
def test_recall_by_edit_similarity(spark, kind):
    """Pairs of random texts of 50 to 1,000 words at edit similarity 0.8 to 0.99: 0.9 of all are found, and of those below 0.85."""
    rng = random.Random(12)
    texts, pairs = {}, []
    for size in (50, 60, 120, 300, 1000):
        for share in (0.01, 0.05, 0.1, 0.14, 0.19, 0.2):
            for _ in range(15):
                base = [f"w{rng.randrange(300 if kind == 'few words' else 10**6)}" for _ in range(size)]
                d = len(texts)
                texts[d], texts[d + 1] = base, _edited(rng, base, max(1, int(share * size)))
                pairs.append((d, d + 1))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string").repartition(7)
    found = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.op9_order_minhash(docs).collect()}
    near = {pair: edit_similarity(texts[pair[0]], texts[pair[1]]) for pair in pairs}
    for low, high, share in ((0.8, 1.01, 0.95), (0.9, 1.01, 0.99), (0.8, 0.85, 0.9)):
        own = [found[a][0] == found[b][0] for (a, b), x in near.items() if low <= x < high]
        assert len(own) > 80 and sum(own) >= share * len(own), (low, len(own), sum(own))
    assert all(size <= 2 for _, size in found.values())


def test_alignment():
    rng = random.Random(3)
    for _ in range(3000):
        kinds = rng.choice([2, 5, 60])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(25))]
        b = _edited(rng, a, rng.randrange(6)) if a and rng.random() < 0.8 else [rng.randrange(kinds) for _ in range(rng.randrange(25))]
        b = [x if isinstance(x, int) else 77 for x in b]
        most, want = rng.randrange(1, 12), edits(a, b)
        got = neardup.edit_distance(np.array(a, int), np.array(b, int), most)
        assert got == want if want <= most else got > most
    one, other = np.arange(10_000), np.arange(10_000)
    other = np.delete(np.where(other % 10 == 3, -1, other), [5, 77])
    assert neardup.aligned(one, other) == 1 - 1002 / 10_000
    assert neardup.aligned(one, one[::-1].copy()) == 0 and neardup.aligned(one[:0], one) == 0 and neardup.aligned(one[:0], one[:0]) == 0
    assert neardup.aligned(np.arange(4), np.arange(4)) == 1 and neardup.aligned(np.arange(4), np.arange(1, 5)) == 0 and neardup.aligned(np.arange(5), np.array([0, 1, 9, 3, 4])) == 0.8


def test_near_duplicates_hard(spark, hard, none):
    found = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.op9_order_minhash(hard).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 2), (4, 4, 2), (None, None, 1), (5, 5, 1), (6, 6, 2), (7, 6, 2)], key=str)
    kept = neardup.deduplicated(hard)
    assert kept.columns == hard.columns and kept.count() == 7 and neardup.deduplicated(none).isEmpty()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    found = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: top(x) for x in linked}
    assert cc.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def _jobs(spark, run):
    """The number of Spark jobs that ``run`` starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_components_take_few_jobs(spark):
    """A round is two tables and one count, as the driver keeps something of each job."""
    links = spark.createDataFrame([(k, 100 + k % 7) for k in range(100)], "a bigint, b bigint")
    assert _jobs(spark, lambda: cc.components(links)) <= 16


def test_keys_of_several_classes(spark):
    rng = random.Random(8)
    shared = [(k, i) for k in range(60) for i in rng.sample(range(40), rng.randrange(2, 30))]
    root = {i: (0 if i < 25 else i - i % 2) for i in range(36)}  # the last have no root yet
    roots = spark.createDataFrame(list(root.items()), "node bigint, root bigint")
    found = neardup._of_several_classes(spark.createDataFrame(shared, "k bigint, id bigint"), roots).collect()
    of, size = {i: root.get(i, i) for i in range(40)}, collections.Counter(root.values())
    want = {}
    for k in range(60):
        ids = [i for x, i in shared if x == k]
        if len({of[i] for i in ids}) > 1:
            largest = max((size.get(of[i], 1), of[i]) for i in ids)[1]
            others = sum(of[i] != largest for i in ids)
            want |= {(k, i): (of[i], largest, min(ids), others <= neardup.FEW and 2 * others <= len(ids)) for i in ids}
    assert {(r["k"], r["id"]): (r["root"], r["largest"], r["first"], r["few"]) for r in found} == want and len(found) == len(want)
    assert all((r["k"], r["pivot"]) in want and of[r["pivot"]] == r["largest"] for r in found) and len({r["few"] for r in found}) == 2


def test_texts_with_a_passage_meet_once(spark):
    """All pairs that have enough labels in common meet, and hardly any under each label that they have in common."""
    rng = random.Random(9)
    label = lambda: rng.randrange(-(2**63), 2**63)
    passage, frequent = [label() for _ in range(80)], [label() for _ in range(30)]
    labels = {i: [*rng.sample(passage, rng.randrange(70, 80)), *rng.sample(frequent, rng.randrange(12)), *[label() for _ in range(rng.randrange(12))]] for i in range(60)}
    root = {i: i - i % 3 if i < 30 else i for i in labels}
    left = spark.createDataFrame([(i, root[i], 0 if i % 10 else 1, x) for i, x in labels.items()], "id bigint, root bigint, g0 bigint, labels array<bigint>")
    found = [tuple(r) for r in neardup._meetings(left, 0.8, neardup.words_needed(0.8)).collect()]
    want = {(a, b) for a in labels for b in range(a) if root[a] != root[b] and (a % 10 > 0) == (b % 10 > 0) and len({*labels[a]} & {*labels[b]}) >= 0.8 * max(len(labels[a]), len(labels[b]))}
    assert want and want <= {*found} and all(root[a] != root[b] for a, b in found)
    assert len(found) <= 2 * len({*found})


# 10


def test_repeats_are_all_found(documents, texts):
    found = substring.op10_paragraph_minhash(documents).collect()
    at = collections.defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 50):
            at[tuple(w[i : i + 51])].add(d)
    covered, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in found:
        if r["kind"] != "paragraph":
            covered[r["doc_id"]] |= set(range(r["place"], r["place"] + r["size"]))
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 50):
            if len(at[tuple(w[i : i + 51])]) > 1:
                want[d] |= set(range(i, i + 51))
    assert covered == want and want
    lines = [(d, k, shingles(x)) for d, t in texts.items() for k, x in enumerate(t.split("\n")) if len(words(x)) >= 51]
    near = {x[:2] for x in lines for y in lines if x[:2] != y[:2] and len(x[2] & y[2]) >= 0.8 * len(x[2] | y[2])}
    assert {(r["doc_id"], r["place"]) for r in found if r["kind"] == "paragraph"} == near


def test_one_copy_of_a_passage_stays(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, short = fresh(55), fresh(50)
    docs = [(d, " ".join([*fresh(30), *(passage if d % 2 else short), *fresh(30)])) for d in range(6)]
    found = substring.op10_paragraph_minhash(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r["kind"], r["doc_id"], r["place"], r["size"], r["class_id"] in (1, 3, 5), r["removed"]) for r in found if r["removed"]) == sorted(("passage", d, 30, 55, True, True) for d in (1, 3, 5) if d != next(r["doc_id"] for r in found if not r["removed"]))
    assert len(found) == 3


def test_repeats_hard(hard, none):
    found = substring.op10_paragraph_minhash(hard).collect()
    assert {r["doc_id"] for r in found} == {6, 7} and substring.op10_paragraph_minhash(none).isEmpty()


# all together


def test_pipeline(spark, documents, texts, tmp_path):
    import corpus_pipeline as cp

    docs, kept = documents, []
    for name, stage in cp.STAGES:
        docs = tables.stored(stage(spark, docs, SMALL), name)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        if name != cp.STAGES[-1][0]:
            assert docs.columns == documents.columns
    assert all(set(b) <= set(a) for a, b in zip(kept, kept[1:]))
    near = _pairs({d: t for d, t in kept[0].items()})
    assert all(a not in kept[1] or b not in kept[1] for a, b in near)
    dirty = {r["doc_id"] for r in decontam.op6_benchmark_decontamination(documents, tables.read(spark, SMALL, "benchmark")).where("contaminated").collect()}
    assert set(kept[2]) == set(kept[1]) - dirty
    assert set(kept[3]) == set(kept[2]) and not any(base_spans(t) for t in kept[3].values())
    assert all(kept[3][d] == kept[2][d] for d in kept[2] if not pii.find(kept[2][d] or "", pii._automaton()))
    assert {r["doc_id"] for r in cp.run(spark, SMALL).collect()} == set(kept[4])


def test_pipeline_hard(spark, hard, none):
    import corpus_pipeline as cp

    for docs in (hard, none):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.columns[: len(docs.columns)] == docs.columns and out.where("_counts != 'clash' OR _kept != 'clash'").isEmpty()
            assert out.count() <= docs.count()


def test_queries_are_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len([n for n in queries.queries() if n.startswith("op")]) == 13


# 11


def test_ranking_tells_held_out_documents(documents, spark):
    labels = tables.read(spark, SMALL, "labels")
    found = {r["doc_id"]: r for r in ranking.op11_pairwise_ranking(documents, labels).collect()}
    assert len(found) == documents.count()
    for doc, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    known = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    good, bad = ([r["score"] for r, q in known if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(r["predicted"] == q for r, q in known) >= 0.95 * len(known)


def test_ranking_learns_from_training_rows_only(documents, spark):
    labels = tables.read(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert ranking.learn(documents, labels) == ranking.learn(documents, turned)


def test_ranking_threshold_is_a_quantile():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, ranking.WIDTH))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > -0.5).astype(int)
    model = ranking.fit(x, y)
    assert abs((model.scores(x) < ranking.CUT).mean() - (y == 0).mean()) < 0.01
    assert abs((ranking.fit(x, y, share=0.5).scores(x) < ranking.CUT).mean() - 0.5) < 0.01
    good, bad = model.scores(x[y == 1]), model.scores(x[y == 0])
    assert (good[:, None] > bad[None]).mean() > 0.95
    preferred, other = ranking.preference_pairs(y, 1000, 1)
    assert (y[preferred] == 1).all() and (y[other] == 0).all() and len(preferred) == len(other) == 1000


def test_ranking_learns_from_all_labelled_rows(spark):
    """Each of 30,000 labelled rows counts, and each block has both labels, however rare one is."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, ranking.WIDTH))
    y = (x[:, 0] + 0.3 * rng.normal(size=30_000) > -0.5).astype(int)
    kind = "h bigint, _features array<double>, _quality int"
    rows = spark.createDataFrame([(k, f, q) for k, (f, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], kind).cache()
    model = ranking.fit_all(rows)
    assert abs((model.scores(x) < ranking.CUT).mean() - (y == 0).mean()) < 0.001
    small = ranking.fit(x, y)
    assert np.corrcoef(model.strengths(x), small.strengths(x))[0, 1] > 0.99
    rare = rows.where("_quality = 1 OR h % 4000 < 3").cache()
    counts = {r["_quality"]: r["count"] for r in rare.groupBy("_quality").count().collect()}
    blocks = ranking._dealt(rare, counts).collect()
    assert len(blocks) == 2 and sum(sum(b["quality"]) for b in blocks) == counts[1] and all(0 in b["quality"] for b in blocks)


def test_ranking_hard(spark, hard, none, documents):
    kind = "doc_id bigint, quality int, toxic int, text string, _quality string"
    labels = spark.createDataFrame([(1, 1, 0, "x", "x"), (4, 0, 0, "x", "x"), (4, 1, 0, "x", "x"), (None, 0, 0, "x", "x"), (6, None, 0, "x", "x"), (7, 0, 1, "x", "x"), (7, 0, 1, "x", "x"), (99, 0, 0, "x", "x")], kind)
    assert ranking.op11_pairwise_ranking(hard, labels).count() == len(HARD)
    assert {r["score"] for r in ranking.op11_pairwise_ranking(hard, labels.limit(0)).collect()} == {0.5}
    assert ranking.op11_pairwise_ranking(none, labels).count() == 0
    small = ranking.learn(documents, tables.read(spark, SMALL, "labels"), sample=30)
    assert small.weights


# 12


def aligned_by_hand(a, b, text):
    """(counts, groups as text, links) from two encodings, token by token."""
    if not text:
        return (0, 0, 0, 0), "", collections.Counter()
    (ids_a,), (ids_b,) = a.encode([" " + text]), b.encode([" " + text])
    ends = []
    for ids, v in ((ids_a, a), (ids_b, b)):
        if b"".join(v.bytes[i].as_py() for i in ids) != (" " + text).encode():
            return (0, 0, 0, 0), "", collections.Counter()
        ends.append(np.cumsum([len(v.bytes[i].as_py()) for i in ids]).tolist())
    i = j = 0
    links, groups, own = [], [], ([], [])
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        x, y = ends[0][i], ends[1][j]
        if x <= y:
            own[0].append(str(ids_a[i]))
        if y <= x:
            own[1].append(str(ids_b[j]))
        if x == y:
            groups.append("|".join(map(",".join, own)))
            own = ([], [])
        i, j = i + (x <= y), j + (y <= x)
    return (len(ids_a), len(ids_b), len(groups), len(links)), ";".join(groups), collections.Counter(links)


def vocabularies():
    import public_tokenizers

    return crosstok.byte_level(public_tokenizers.path("byte_bpe_50k.json")), crosstok.pieces(public_tokenizers.path("piece_bpe_32k.model"))


def check_alignment(given, found):
    a, b = vocabularies()
    want = [aligned_by_hand(a, b, t) for t in given]
    held = collections.Counter(p for _, _, links in want for p in links)
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    expected = collections.Counter()
    for counts, groups, links in want:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        expected[(*counts, sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), digest)] += 1
    assert collections.Counter(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found) == expected


def test_byte_owners(documents, texts):
    check_alignment(list(texts.values()), crosstok.op12_byte_owners(documents).collect())


def test_byte_owners_on_odd_texts(spark):
    given = [None, "", " ", "  ", "a ", "a  b", "a \n b", "x▁y", "<|endoftext|> a", "<s> </s> <unk> <0x41>", "　 a 　 b", "é à ü  ö", "\x00 a b", "a  b", "a\u0085 b c", "ﬁ ₂ ½", "\n\n a", "don't 's 12 345 6x", "字 漢 字字", "😀 😀 a", "x" * 3000, "x" * 3000, " " * 300, "a\x7f b c", "Á b   c d", "same text", "same text"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "doc_id bigint, text string").repartition(3)
    found = crosstok.aligned(docs, *(__import__("public_tokenizers").path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")), 32_000, block_pairs=10)
    check_alignment(given, found.collect())


def test_pieces_are_those_of_the_whole_text():
    a, b = vocabularies()
    model = crosstok.Aligner(a, b)
    rng = random.Random(7)
    given = ["".join(rng.choice(["a", "é", " ", "  ", "\n", ".", "the", "\t", "　", "7", "'s", "😀", "<s>"]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    found = model.align(pa.array(given))
    assert list(zip(*(found[c].tolist() for c in crosstok.COUNTS))) == [aligned_by_hand(a, b, t)[0] for t in given]
    again = model.align(pa.array(given))  # out of memory now
    assert again["sha"] == found["sha"] and (again["pairs"] == found["pairs"]).all()


def test_byte_owners_hard(hard, none):
    found = crosstok.op12_byte_owners(hard).collect()
    check_alignment([r[1] for r in HARD], found)
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r[0] for r in HARD)
    assert crosstok.op12_byte_owners(none).count() == 0


# 13


def searched(docs, items, top=50):
    """{item: [(doc_id, score)]} by the contract's formula over all pairs."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts = [(d, collections.Counter(re.findall(pattern, (t or "").translate(lower)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = {}
    for item, text in items:
        terms = set(re.findall(pattern, (text or "").translate(lower)))
        scores = [(sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * sum(c.values()) * n // total))) for t in terms if t in c), d) for d, c in counts]
        out[item] = [(d, s) for s, d in sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1]))[:top]]
    return out


def ranking_of(found):
    out = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_search_sql(spark):
    found = queries.queries()["op13_threshold_search"](spark, SMALL).toPandas()
    assert rows(found) == rows(database(SMALL).sql(lexical.ORACLE).df())


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_is_exact(spark, top):
    rng = random.Random(top)
    pool = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(rng.choices(pool, weights, k=rng.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[5][1]) for k in range(80)] + [(2000, None), (2001, " .,")]
    items = [(k, " ".join(rng.choices(pool, weights if k % 2 else None, k=rng.choice([1, 5, 40])))) for k in range(20)] + [(99, "absent"), (98, "")]
    found = ranking_of(lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), top))
    want = searched(docs, items, top)
    assert found == {k: v for k, v in want.items() if v}


def test_search_in_blocks(spark, monkeypatch):
    docs = [(k, f"a{k % 7} b{k % 5} c{k % 3} d common") for k in range(120)]
    items = [(k, f"a{k % 9} b{k} c1 common") for k in range(12)]
    own = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda *given: own(*given, block_terms=5))
    monkeypatch.setattr(lexical, "CELLS", 10)
    found = ranking_of(lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 4))
    assert found == searched(docs, items, 4)


def test_search_hard(spark, hard, none):
    items = spark.createDataFrame([(1, "one words a", "x"), (2, None, "x"), (3, "", "x"), (3, "b", "x"), (None, "two", "x"), (5, "x" * 300_000, "x")], "item_id bigint, text string, term string")
    found = lexical.search(hard, items).collect()
    assert collections.Counter(r["item_id"] for r in found) == {1: 5, 3: 2, None: 1, 5: 1}
    assert [(r["doc_id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"]) if r["item_id"] == 3] == [(6, 1), (7, 2)]
    assert lexical.search(none, items).count() == 0 and lexical.search(hard, items.limit(0)).count() == 0
