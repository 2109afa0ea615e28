"""The queries, each with the SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import timeutil as tm
from quillgraph.functions.tables import stored
from quillgraph.operators import batch as ba
from quillgraph.operators import classify as cl
from quillgraph.operators import evaluation as ev
from quillgraph.operators import learning as le
from quillgraph.operators import lifecycle as lc
from quillgraph.operators import outbox as ob
from quillgraph.operators import promotion as pr
from quillgraph.operators import relations as rl
from quillgraph.operators import retrieval as rt
from quillgraph.plans.intents import PRESETS
from quillgraph.plans.vocabulary import MARKERS, Vocabulary
from quillgraph.queries import views as vw
from quillgraph.queries.views import AS_OF, CHANGES_SQL, EVENTS_AS_OF, LINKS_SQL, ORDERS_SQL, PAIRS_SQL, PARTS_SQL, TOKEN, table
from quillgraph.sources import blocks as bl
from quillgraph.sources import cursors as cu
from quillgraph.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        own = name or function.__name__
        QUERIES[own] = function
        if sql is not None:
            ORACLES[own] = sql
        return function

    return add


SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"

# ---- text ----


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS token FROM documents) GROUP BY token")
def token_document_frequency(spark, folder):
    return le.token_document_frequency(table(spark, folder, "documents"), F.col("text"))


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS name_slug, {SLUG.format('p_brand')} AS brand_slug FROM part")
def slugify_titles(spark, folder):
    return table(spark, folder, "part").select("p_partkey", tx.slugify("p_name").alias("name_slug"), tx.slugify("p_brand").alias("brand_slug"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '{tx.EMAIL}', '[redacted-email]', 'g'), '{tx.SECRET}', '[redacted-secret]', 'g') AS content FROM documents""")
def redact_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.strip_secrets("text").alias("content"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\[([^\]]+)\]\(([^)]+)\)', '\1', 'g'), '`{1,3}([^`]+)`{1,3}', '\1', 'g')) AS digest
FROM (SELECT doc_id, '[' || lang || '](a' || doc_id || '.md) `' || source || '` ' || text AS t FROM documents)""")
def markdown_to_text(spark, folder):
    text = F.concat(F.lit("["), F.col("lang"), F.lit("](a"), F.col("doc_id"), F.lit(".md) `"), F.col("source"), F.lit("` "), F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.markdown_to_text(text)).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, trim(unnest(regexp_extract_all('see [x](b' || doc_id || '.md#part) ' || text || ' and [y](c%20d.md), not [z](https://a.b/c.md) or [w](#top) or [v](pic.png)', '{LINK}', 1))) AS t FROM documents)
SELECT doc_id, split_part(url_decode(t), '#', 1) AS target FROM t WHERE t != '' AND t NOT LIKE '#%' AND NOT regexp_matches(lower(t), '^(https?://|mailto:|notion://)') AND lower(t) LIKE '%.md%'""".replace("{LINK}", tx.LINK))
def markdown_links(spark, folder):
    text = F.concat(F.lit("see [x](b"), F.col("doc_id"), F.lit(".md#part) "), F.col("text"), F.lit(" and [y](c%20d.md), not [z](https://a.b/c.md) or [w](#top) or [v](pic.png)"))
    return table(spark, folder, "documents").select("doc_id", F.explode(tx.link_targets(text)).alias("target"))


@query("SELECT p_partkey, p_brand AS title, p_type AS status, p_name || '; ' || p_type AS tags, 'Body of ' || p_name AS content, p_name AS heading FROM part")
def front_matter_fields(spark, folder):
    text = F.concat(F.lit("---\ntitle: '"), F.col("p_brand"), F.lit("'\n# a remark\nstatus: "), F.col("p_type"), F.lit("\ntags: ["), F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit('"]\n---\n# '), F.col("p_name"), F.lit("\nBody of "), F.col("p_name"), F.lit("\n"))
    own = table(spark, folder, "part").withColumn("t", text).withColumns({"m": tx.front_matter("t"), "b": tx.without_front_matter("t")})
    return own.select("p_partkey", F.col("m")["title"][0].alias("title"), F.col("m")["status"][0].alias("status"), F.array_join(F.col("m")["tags"], "; ").alias("tags"), tx.content_of("b").alias("content"), tx.title_of("b", F.lit("none")).alias("heading"))


_LINE_BLOCKS = r"""CASE WHEN t IN ('---', '***') THEN ['divider', '', NULL] WHEN starts_with(t, '### ') THEN ['heading_3', trim(substr(t, 5)), NULL] WHEN starts_with(t, '## ') THEN ['heading_2', trim(substr(t, 4)), NULL]
WHEN starts_with(t, '# ') THEN ['heading_1', trim(substr(t, 3)), NULL] WHEN regexp_matches(t, '^- \[[xX]\] ') THEN ['to_do', trim(substr(t, 7)), 'true'] WHEN starts_with(t, '- [ ] ') THEN ['to_do', trim(substr(t, 7)), 'false']
WHEN regexp_matches(t, '^[-*+] ') THEN ['bulleted_list_item', trim(substr(t, 3)), NULL] WHEN regexp_matches(t, '^[0-9]+\. ') THEN ['numbered_list_item', trim(regexp_replace(t, '^[0-9]+\. ', '')), NULL]
WHEN starts_with(t, '>') THEN ['quote', ltrim(substr(t, 2)), NULL] ELSE ['paragraph', t, NULL] END"""


# the given texts have no fences of their own
@query(rf"""WITH l AS (SELECT doc_id AS id, unnest(string_split_regex('# ' || lang || chr(10) || '- [x] done' || chr(10) || chr(0) || chr(10) || text, '\r?\n')) AS t, unnest(range(1, 4 + len(string_split_regex(text, '\r?\n')))) AS n FROM documents),
b AS (SELECT id, n, CASE WHEN n = 3 THEN ['code', 'select 1', NULL] ELSE {_LINE_BLOCKS} END AS b FROM (SELECT id, n, trim(t) AS t FROM l) WHERE t != '')
SELECT id, row_number() OVER (PARTITION BY id ORDER BY n)::INT AS ordinal, b[1] AS type, md5(b[2]) AS text, CASE WHEN n = 3 THEN 'sql' END AS language, b[3]::BOOLEAN AS checked FROM b""")
def blocks_from_markdown(spark, folder):
    content = F.concat(F.lit("# "), F.col("lang"), F.lit("\n- [x] done\n```sql\nselect 1\n```\n"), F.col("text"))
    return bl.markdown_to_blocks(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), content.alias("content"))).withColumn("text", F.md5("text"))


# ---- mining ----


def _bigrams_sql(texts: str) -> str:
    """c: value, confidence, doc_freq and pmi of all bigrams of the texts (column text)."""
    return f"""d AS (SELECT regexp_extract_all(lower(text), '{TOKEN}') AS t FROM ({texts})), n AS (SELECT count(*)::DOUBLE AS n FROM d),
f AS (SELECT token, count(*) AS f FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token),
b AS (SELECT l, r, count(*) AS df FROM (SELECT DISTINCT k, t[i] AS l, t[i + 1] AS r FROM (SELECT row_number() OVER () AS k, t FROM d), unnest(range(1, len(t))) AS u(i)) WHERE l NOT IN {tx.BIGRAM_STOPS} AND r NOT IN {tx.BIGRAM_STOPS} GROUP BY l, r),
s AS (SELECT l || '-' || r AS value, df AS doc_freq, ln(df * n / (fl.f * fr.f)) AS pmi, n FROM b, n, f fl, f fr WHERE fl.token = l AND fr.token = r AND df >= 2 AND df < n),
c AS (SELECT value, round(least(1.0, 0.6 * doc_freq / n + 0.25 * ln(n / doc_freq) / ln(n) + 0.15 * greatest(pmi / ln(n), 0)), 3) AS confidence, doc_freq, round(pmi, 3) AS pmi FROM s)"""


@query(f"WITH {_bigrams_sql('SELECT text FROM documents')} SELECT * FROM c WHERE confidence >= 0.25 ORDER BY confidence DESC, value LIMIT 50")
def bigram_proposals(spark, folder):
    return le.mine_bigrams(table(spark, folder, "documents"), F.col("text"), least_confidence=0.25)


_PARTS_IN = ", ".join(f"'{p}'" for p in tx.COMMON_PARTS)


@query(rf"""WITH m AS (SELECT unnest(regexp_extract_all(url, '{tx.PATH}')) AS m FROM pages), p AS (SELECT lower(unnest(string_split(m, '/'))) AS p FROM m),
w AS (SELECT CASE WHEN p LIKE '%.%' THEN regexp_extract(p, '^(.*)\.[^.]*$', 1) ELSE p END AS s FROM p WHERE {SLUG.format("p")} NOT IN ('', {_PARTS_IN})),
v AS (SELECT {SLUG.format("s")} AS value FROM w)
SELECT value, round(least(1.0, 0.4 + 0.1 * count(*)), 3) AS confidence, count(*) AS occurrences FROM v WHERE value NOT IN ('', {_PARTS_IN}) GROUP BY value HAVING count(*) >= 2""")
def code_path_components(spark, folder):
    return le.mine_code_paths(table(spark, folder, "pages"), F.col("url"), limit=None)


@query(f"""WITH c AS (SELECT c_custkey AS id, r_name || ' > ' || n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), t AS (SELECT count(*) AS total FROM c),
e AS (SELECT id, i - 1 AS depth, {SLUG.format("trim(string_split(parent, '>')[i])")} AS value FROM c, range(1, 3) AS u(i)),
s AS (SELECT value, count(DISTINCT id) AS records, count(*) AS occurrences, avg(depth) AS d FROM e WHERE value != '' GROUP BY value)
SELECT value, round(0.4 * records / total + 0.4 * (1 - records / total) + 0.2 * greatest(0, 1 - d / 5.0), 3) AS confidence, records / total AS support, round(d, 2) AS average_depth, occurrences
FROM s, t WHERE records >= 2 AND NOT (records = total AND d = 0)""")
def hierarchy_proposals(spark, folder):
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return le.mine_hierarchy(own.select(F.col("c_custkey").alias("id"), F.concat_ws(" > ", "r_name", "n_name").alias("parent")))


_LONG = "UNPIVOT (SELECT id, o_custkey, o_orderkey, explicit, type, goal, status, severity, domain, flow, artifact FROM r) ON type, goal, status, severity, domain, flow, artifact INTO NAME field VALUE value"


@query(f"""WITH {ORDERS_SQL}, l AS ({_LONG}), t AS (SELECT count(*) AS total FROM r),
v AS (SELECT field, value, count(*) AS n, count_if(explicit) AS e FROM l GROUP BY ALL),
f AS (SELECT field, sum(n) AS n, sum(e) AS e, count(*) AS k, sum(n * log2(n)) AS s FROM v GROUP BY field)
SELECT field, round(0.3 * n / total + 0.4 * CASE WHEN k <= 1 THEN 0 ELSE (log2(n) - s / n) / log2(k) END + 0.3 * e / n, 3) AS importance FROM f, t""")
def marker_importance(spark, folder):
    return le.marker_importance(vw.order_records(spark, folder))


_PART_TEXT = "SELECT p_name || ' ' || p_name || ' ' || p_type || ' ' || p_brand || ' size' || p_size AS text FROM part"


@query(f"""WITH {_bigrams_sql(_PART_TEXT)}, ng AS (SELECT value, confidence FROM c WHERE confidence >= 0.5 ORDER BY confidence DESC, value LIMIT 50),
hi AS (SELECT {SLUG.format("p_brand")} AS value, round(0.4 + 0.2 * (1 - 1 / 5.0), 3) AS confidence FROM part GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT value, 'hierarchy' AS source, confidence::DOUBLE AS confidence, 0 AS strategy FROM hi UNION ALL SELECT value, 'ngram', confidence::DOUBLE, 1 FROM ng)
SELECT value, source, confidence, strategy FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY strategy) AS k FROM x) WHERE k = 1""")
def learn_proposals(spark, folder):
    own = vw.part_records(spark, folder).withColumn("parent", F.concat_ws(" > ", F.lit("parts"), "p_brand")).withColumn("regions_used", F.array(F.lit("body")))
    known = spark.createDataFrame([("parts",)], "value string")
    return le.unseen_proposals(le.full_pass(own)["proposals"], known)


# ---- classification ----

_SHOP = Vocabulary(
    {"artifact": ["ring", "anvil", "gizmo", "bolt", "gear", "plate", "rod", "widget"], "flow": ["small", "large", "old", "new", "hot", "cold", "red", "blue"], "type": ["promo", "economy", "medium", "large", "standard", "small"]},
    {"artifact": {"widget": ["gizmo"]}, "type": {"promo": ["hot"]}},
    ("type",),
    ("type", "artifact"),
)
_FORMS = ", ".join(f"('{n}', '{v}', {i}, '{f}')" for n, values in _SHOP.markers.items() for i, v in enumerate(values) for f in _SHOP.forms(n, v))
_SCORES_SQL = f"""form(field, value, ordinal, form) AS (VALUES {_FORMS}),
reg AS (SELECT p_partkey, 3.0 AS w, p_name AS t FROM part UNION ALL SELECT p_partkey, 1.0, p_type || ' ' || p_name FROM part),
hit AS (SELECT p_partkey, w, {SLUG.format("tok")} AS form FROM (SELECT p_partkey, w, unnest(regexp_extract_all(lower(t), '{TOKEN}')) AS tok FROM reg)),
sc AS (SELECT p_partkey, field, value, round(sum(w) / 15.0, 4) AS score FROM hit JOIN form USING (form) GROUP BY p_partkey, field, value)"""


def _shop(spark, folder):
    # by key: a file of a few MB is one task, and a row costs far more than its bytes
    own = table(spark, folder, "part").select("p_partkey", "p_name", "p_type").repartition("p_partkey")
    own = own.select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("content"), F.lit("").alias("parent"))
    return own.select("p_partkey", F.inline(F.array(F.struct(cl.regions().alias("r"))))).withColumn("s", cl.matched_scores("r", _SHOP))


@query(f"WITH {_SCORES_SQL} SELECT p_partkey, field, value, score FROM sc")
def classify_region_scores(spark, folder):
    return _shop(spark, folder).select("p_partkey", F.inline("s")).select("p_partkey", "field", "value", "score")


@query(f"""WITH {_SCORES_SQL}, al AS (SELECT p_partkey, field, value, coalesce(score, 0.0) AS score, sc.value IS NOT NULL AS matched FROM (SELECT p_partkey, field, value FROM part, (SELECT DISTINCT field, value FROM form)) LEFT JOIN sc USING (p_partkey, field, value)),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, field ORDER BY score DESC, matched DESC, value) AS n, coalesce(lead(score) OVER (PARTITION BY p_partkey, field ORDER BY score DESC, matched DESC, value), 0) AS next FROM al)
SELECT p_partkey, field, CASE WHEN score < 0.2 THEN 'fallback' WHEN score >= 0.75 AND round(score - next, 4) >= 0.15 THEN 'deterministic' ELSE 'pending-arbitration' END AS arbiter,
CASE WHEN score >= 0.2 THEN value END AS value, score, CASE WHEN score >= 0.2 THEN round(score - next, 4) ELSE 0 END AS gap FROM k WHERE n = 1""")
def classify_arbitrate(spark, folder):
    # each step behind a generator: scores and candidates are used several times and must be made once
    own = _shop(spark, folder).select("p_partkey", F.inline(F.array(F.struct("s"))))
    each = own.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), cl.top_candidates("s", n, _SHOP).alias("candidates")) for n in _SHOP.markers])))
    decided = each.select("p_partkey", "field", F.inline(F.array(F.struct(cl.arbitrated(F.col("candidates")).alias("d")))))
    return decided.select("p_partkey", "field", "d.arbiter", "d.value", "d.score", "d.gap")


@query("""SELECT 'order:' || o_orderkey AS id, 'record:' || trim(regexp_replace(lower(trim(o_orderpriority || ' ' || o_orderstatus)), '[^a-z0-9]+', '-', 'g'), '-') AS title_id,
CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'in-progress' ELSE 'known-risk' END AS status, CASE o_orderstatus WHEN 'P' THEN 'third-party-thing' ELSE 'payments' END AS domain FROM orders""")
def normalize_markers_alias(spark, folder):
    raw = F.when(F.col("o_orderstatus") == "F", "Resolved").when(F.col("o_orderstatus") == "O", " WIP ").otherwise("open risk")
    domain = F.when(F.col("o_orderstatus") == "P", "Third Party Thing").otherwise("Billing")
    own = table(spark, folder, "orders").withColumn("m", F.create_map(F.lit("status"), F.array(raw), F.lit("domain"), F.array(domain), F.lit("owner"), F.array(F.lit(""))))
    own = own.withColumn("n", cl.normalized_markers("m", Vocabulary())).withColumn("title", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    return own.select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), cl.record_id(own).alias("title_id"), cl.scalar("n", "status").alias("status"), cl.scalar("n", "domain").alias("domain"))


@query(f"WITH {ORDERS_SQL} SELECT id, domain || ' > ' || flow || ' > ' || artifact AS path, 3 AS depth FROM r")
def derive_hierarchy(spark, folder):
    return vw.order_records(spark, folder).withColumn("h", cl.hierarchy("markers", Vocabulary())).select("id", "h.path", F.size("h.segments").alias("depth"))


@query()
def classify_records(spark, folder):
    own = vw.order_records(spark, folder).select("id", "title", "content")
    out = cl.classify(own, Vocabulary())
    return out.select("id", "arbiter", cl.scalar("markers", "flow").alias("flow"), cl.scalar("markers", "artifact").alias("artifact"), F.array_join("missing_required", ",").alias("missing"), "hierarchy.path")


# ---- scores and packs ----

_AGE = f"greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0, 0)"
_HALF = "CASE type WHEN 'rule' THEN 365 WHEN 'decision' THEN 180 WHEN 'architecture' THEN 180 WHEN 'task' THEN 30 WHEN 'incident' THEN 30 WHEN 'bug' THEN 30 ELSE 60 END"


@query(f"WITH {ORDERS_SQL} SELECT id, round(pow(0.5, {_AGE} / {_HALF}), 9) AS factor FROM r")
def freshness_decay(spark, folder):
    return vw.order_records(spark, folder).select("id", F.round(tm.freshness(cl.scalar("markers", "type"), F.col("updated_at"), AS_OF), 9).alias("factor"))


@query(f"WITH {ORDERS_SQL} SELECT id, round(exp(-{_AGE} / 30), 9) AS recency FROM r")
def recency_score(spark, folder):
    return vw.order_records(spark, folder).select("id", F.round(tm.recency(F.col("updated_at"), AS_OF), 9).alias("recency"))


def _asked(mode: str | None = None, **options) -> rt.Query:
    return rt.Query.of("urgent webhook building retry", {"severity": "critical", "domain": "building"}, mode, half_lives={"default": 900.0, "task": 900.0, "bug": 900.0, "incident": 900.0}, **options)


def _cases(column: str, weights: dict[str, float], other: float = 1.0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END" if weights else str(other)


def _score_sql(mode: str | None = None) -> str:
    """r with raw and score of the query in _asked."""
    asked = _asked()
    intent = PRESETS.get(mode) if mode else None
    equal = {n: f"({n} = '{v}')::INT" for n, v in asked.markers.items()}
    n = " + ".join(equal.values())
    exact = f"({n}) / {float(len(equal))}"
    boost = "1.0::DOUBLE"
    if intent:
        exact += f" * CASE WHEN {n} = 0 THEN 1.0 ELSE ({' + '.join(f'{e} * {intent.table('marker').get(m, 1.0)}' for m, e in equal.items())}) / ({n}) END"
        boost = f"({_cases('type', intent.table('type'))})::DOUBLE * ({_cases('status', intent.table('status'))})::DOUBLE * {intent.setting('freshness')}"
    tokens = f"len(list_intersect(tokens, {vw._sql_list(asked.tokens)}))"
    base = f"{exact} * 0.45::DOUBLE + {tokens} / {float(len(asked.tokens))}::DOUBLE * 0.2 + {_cases('severity', rt.SEVERITY, 0.0)}::DOUBLE * 0.15 + {_cases('status', rt.STATUS, rt.OTHER_STATUS)}::DOUBLE * 0.1 + exp(-{_AGE} / 30.0) * 0.1"
    half = "CASE type WHEN 'rule' THEN 365 WHEN 'decision' THEN 180 WHEN 'architecture' THEN 180 ELSE 900 END"
    return f"""{ORDERS_SQL}, raw AS (SELECT *, {n} AS n_markers, {tokens} AS n_tokens, round(({base}) * {boost}::DOUBLE + 5e-10, 3) AS raw FROM r WHERE NOT archived),
s AS (SELECT *, round(raw * pow(0.5, {_AGE} / {half}) + 5e-10, 3) AS score FROM raw), hit AS (SELECT * FROM s WHERE score > 0 AND n_markers + n_tokens > 0),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank FROM hit)"""


def _scored(mode: str | None = None):
    def run(spark, folder):
        own = rt.scored(vw.order_records(spark, folder), _asked(mode), AS_OF)
        return own.select("id", F.size("f.matched_markers").alias("n_markers"), F.size("f.matched_tokens").alias("n_tokens"), "f.raw", "f.score", "relevant")

    return run


for _mode in (None, *PRESETS):
    query(f"WITH {_score_sql(_mode)} SELECT id, n_markers::INT AS n_markers, n_tokens::INT AS n_tokens, raw, score, score > 0 AND n_markers + n_tokens > 0 AS relevant FROM s", f"score_records{'_intent_' + _mode if _mode else ''}")(_scored(_mode))


def _pack(spark, folder):
    return rt.pack(vw.order_records(spark, folder), _asked(), AS_OF)


@query(f"WITH {_score_sql()} SELECT id, rank::INT AS rank, score, type IN ('rule', 'decision') AS promoted_rule, status IN ('in-progress', 'known-risk') AND severity IN ('critical', 'high') AS unresolved_risk FROM k WHERE rank <= 8")
def context_pack_topk(spark, folder):
    return _pack(spark, folder).where("section = 'direct'").select("id", "rank", "score", "promoted_rule", "unresolved_risk")


@query(f"WITH {_score_sql()} SELECT id, rank::INT AS rank, score FROM k WHERE rank BETWEEN 9 AND 13 AND score >= 0.3")
def context_pack_supporting(spark, folder):
    return _pack(spark, folder).where("section = 'supporting'").select("id", "rank", "score")


@query(f"WITH {_score_sql()} SELECT id FROM k WHERE rank <= 8 AND type IN ('rule', 'decision')")
def promoted_rules(spark, folder):
    return _pack(spark, folder).where("promoted_rule").select("id")


@query(f"WITH {_score_sql()} SELECT id FROM k WHERE rank <= 8 AND status IN ('in-progress', 'known-risk') AND severity IN ('critical', 'high')")
def unresolved_risks(spark, folder):
    return _pack(spark, folder).where("unresolved_risk").select("id")


@query(f"WITH {_score_sql()} SELECT (count(*) - count_if(rank <= 8 OR rank <= 13 AND score >= 0.3))::BIGINT AS omitted FROM k")
def omitted_count(spark, folder):
    return rt.omitted_count(vw.order_records(spark, folder), _asked(), AS_OF)


@query(f"WITH {_score_sql()} SELECT id, raw, score, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM s WHERE raw > 0")
def inspect_rank(spark, folder):
    return rt.inspect_rank(vw.order_records(spark, folder), _asked(), AS_OF)


@query(f"WITH {_score_sql()}, x AS (SELECT id, raw, score, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM s WHERE raw > 0) SELECT x.* FROM x WHERE id IN (SELECT 'order:' || event_id FROM events)")
def ranks_of_some(spark, folder):
    wanted = table(spark, folder, "events").select(F.concat(F.lit("order:"), F.col("event_id")).alias("id"))
    return rt.ranks_of(rt.raw_scores(vw.order_records(spark, folder), _asked(), AS_OF), wanted)


@query(f"""WITH {_score_sql()} SELECT id, {_cases("severity", rt.SEVERITY, 0.0)}::DOUBLE AS severity, {_cases("status", rt.STATUS, rt.OTHER_STATUS)}::DOUBLE AS status, round(n_markers / 4.0, 6) AS exactness, round(n_tokens / 4.0, 6) AS token_overlap, raw FROM s""")
def inspect_factors(spark, folder):
    own = rt.scored(vw.order_records(spark, folder), _asked(), AS_OF)
    return own.select("id", "f.severity", "f.status", F.round("f.exactness", 6).alias("exactness"), F.round("f.token_overlap", 6).alias("token_overlap"), "f.raw")


_PART_QUERY = rt.Query(text="hot gizmo", markers={"domain": "brand-11"}, half_lives={"default": 1e12}, max_hops=2, limit=8)


def _hops_sql(hops: int) -> str:
    base = f"""{PARTS_SQL}, {LINKS_SQL},
own AS (SELECT id, p_partkey, (domain = 'brand-11')::INT AS m, len(list_intersect(tokens, ['gizmo', 'hot'])) AS t, round(round((domain = 'brand-11')::INT * 0.45 + len(list_intersect(tokens, ['gizmo', 'hot'])) / 2.0::DOUBLE * 0.2 + 0.025 + exp(-31 / 30.0) * 0.1 + 5e-10, 3) * pow(0.5, 31 / 1e12) + 5e-10, 3) AS own FROM p0),
l0 AS MATERIALIZED (SELECT id, own AS score, 0 AS hop, [p_partkey::BIGINT] AS disc FROM own WHERE m + t > 0 AND own > 0), f0 AS (SELECT * FROM l0)"""
    for h in range(1, hops + 1):
        base += f""", l{h} AS MATERIALIZED (SELECT target AS id, score, {h} AS hop, disc FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY disc) AS n FROM (SELECT k.target, round(greatest(o.own * pow(0.5, {max(0, h - 1)}), l.score * 0.5) + 5e-10, 3) AS score, list_append(l.disc, k.ordinal::BIGINT) AS disc
FROM l{h - 1} l JOIN links k ON k.source = l.id JOIN own o ON o.id = k.target WHERE k.target NOT IN (SELECT id FROM f{h - 1})) WHERE score > 0) WHERE n = 1),
f{h} AS (SELECT * FROM f{h - 1} UNION ALL SELECT * FROM l{h})"""
    return f"WITH {base} SELECT id, score, hop FROM f{hops}"


def _hops(hops: int):
    def run(spark, folder):
        from dataclasses import replace

        return rt.ranked(vw.part_records(spark, folder, related=True), replace(_PART_QUERY, max_hops=hops), AS_OF).select("id", "score", "hop")

    return run


query(_hops_sql(1), "one_hop_expansion")(_hops(1))
query(_hops_sql(2), "multi_hop_expansion")(_hops(2))

# ---- edges ----


@query(f"WITH {PAIRS_SQL} SELECT source, target, type, confidence, matched, shared FROM inferred")
def infer_edges(spark, folder):
    own = rl.inferred_edges(vw.part_records(spark, folder))
    return own.select("source", "target", "type", "confidence", F.array_join("matched_markers", ",").alias("matched"), F.array_join("shared_tokens", ",").alias("shared"))


@query(f"WITH {PAIRS_SQL} SELECT type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM inferred GROUP BY type")
def edge_types(spark, folder):
    return rl.inferred_types(vw.part_records(spark, folder)).withColumn("mean_confidence", F.round("mean_confidence", 6))


_EXPLICIT_SQL = "x AS (SELECT DISTINCT source, target, 'related_to' AS type, 'explicit' AS kind, 1.0::DOUBLE AS confidence FROM links)"


@query(f"WITH {PAIRS_SQL}, {LINKS_SQL}, {_EXPLICIT_SQL} SELECT source, target, type, kind, confidence FROM x UNION ALL SELECT source, target, type, 'inferred', confidence FROM inferred")
def edges_merged_explicit(spark, folder):
    return rl.all_edges(vw.part_records(spark, folder, related=True), AS_OF).select("source", "target", "type", "kind", "confidence")


@query(f"""WITH {PAIRS_SQL}, {LINKS_SQL}, {_EXPLICIT_SQL}, a AS (SELECT source, target, type, kind, confidence FROM x UNION ALL SELECT source, target, type, 'inferred', confidence FROM inferred)
SELECT source, target, type, kind, confidence, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, confidence DESC, target, type) AS n FROM a) WHERE n <= 10""")
def top_outgoing_edges(spark, folder):
    return rl.top_edges(vw.part_records(spark, folder, related=True))


@query(f"""WITH {PAIRS_SQL}, {LINKS_SQL}, {_EXPLICIT_SQL}, a AS (SELECT source, target, type, kind, confidence FROM x UNION ALL SELECT source, target, type, 'inferred', confidence FROM inferred),
gone AS (SELECT id FROM p0 WHERE p_partkey % 50 = 7) SELECT * FROM a WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""")
def incremental_delete_edges(spark, folder):
    own = vw.part_records(spark, folder)
    edges = rl.all_edges(vw.part_records(spark, folder, related=True), AS_OF)
    gone = own.where("ingest_ordinal % 50 = 7").select("id")
    return lc.delete(own, edges, gone, AS_OF)[1].select("source", "target", "type", "kind", "confidence")


_EVENT_EDGES = """ee AS (SELECT 'user:' || user_id AS source, 'type:' || event_type AS target, event_id, CASE WHEN event_id % 4 = 0 THEN 'explicit' ELSE 'inferred' END AS kind, CASE WHEN event_id % 9 != 0 THEN ts END AS created_at FROM events)"""


def _event_edges(spark, folder):
    own = table(spark, folder, "events")
    return own.select(F.concat(F.lit("user:"), F.col("user_id")).alias("source"), F.concat(F.lit("type:"), F.col("event_type")).alias("target"), "event_id", F.when(F.col("event_id") % 4 == 0, "explicit").otherwise("inferred").alias("kind"), F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp")).alias("created_at"))


_ALIVE = f"kind != 'inferred' OR created_at IS NULL OR greatest((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(created_at)) / 86400000000.0, 0) <= 30"


@query(f"WITH {_EVENT_EDGES} SELECT event_id, source, target, kind FROM ee WHERE {_ALIVE}")
def edges_ttl(spark, folder):
    return rl.visible_edges(_event_edges(spark, folder), EVENTS_AS_OF).select("event_id", "source", "target", "kind")


@query(f"WITH {_EVENT_EDGES}, vis AS (SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE user_id % 3 != 0 UNION ALL SELECT DISTINCT 'type:' || event_type FROM events WHERE event_type != 'click') SELECT event_id, source, target FROM ee WHERE ({_ALIVE}) AND source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)")
def edge_visibility(spark, folder):
    own = table(spark, folder, "events")
    visible = own.where("user_id % 3 != 0").select(F.concat(F.lit("user:"), F.col("user_id")).alias("id")).union(own.where("event_type != 'click'").select(F.concat(F.lit("type:"), F.col("event_type")))).distinct()
    return rl.visible_edges(_event_edges(spark, folder), EVENTS_AS_OF, visible).select("event_id", "source", "target")


# ---- lifecycle ----

_FOLD_SQL = f"""{CHANGES_SQL}, c2 AS (SELECT *, sum((edited IS NULL)::INT) OVER (PARTITION BY id ORDER BY ordinal) AS run FROM ch),
c3 AS (SELECT *, max(edited) OVER (PARTITION BY id, run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c2),
ap AS (SELECT * FROM c3 WHERE edited IS NULL OR held IS NULL OR edited >= held)"""


@query(f"WITH {_FOLD_SQL} SELECT id, max(ordinal) AS ordinal, count(*)::INT AS version FROM ap GROUP BY id")
def revision_versions(spark, folder):
    return lc.folded(vw.event_changes(spark, folder))


@query(f"WITH {_FOLD_SQL}, l AS (SELECT id, max(ordinal) AS ordinal FROM ap GROUP BY id) SELECT id, event_type, value FROM ch JOIN l USING (id, ordinal)")
def merge_upsert_latest(spark, folder):
    changes = vw.event_changes(spark, folder)
    return changes.join(lc.folded(changes).select("id", "ordinal"), ["id", "ordinal"]).select("id", "event_type", "value")


@query(f"WITH {ORDERS_SQL} SELECT id FROM r WHERE (NOT archived OR o_orderkey IN (10, 20)) AND o_orderkey != 1")
def archive_filter(spark, folder):
    own = lc.set_archived(lc.set_archived(vw.order_records(spark, folder), ["order:10", "order:20"], False), ["order:1"])
    return rt.unarchived(own).select("id")


def _snapshots(spark, folder):
    own = table(spark, folder, "orders")
    base = own.select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title"), "o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_custkey").alias("content"), F.create_map(F.lit("status"), F.array("o_orderstatus")).alias("markers"), F.col("o_orderdate").cast("timestamp").alias("last_edited_time"), F.lit(1).alias("version"))
    left = base.where("last_edited_time < '2000-01-01'").select("id", lc.fingerprint().alias("fingerprint"))
    changed = base.withColumns({"title": F.when(F.col("o_orderkey") % 11 == 0, "changed").otherwise(F.col("title")), "version": F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1)})
    right = changed.where("o_orderkey % 13 != 0").select("id", lc.fingerprint().alias("fingerprint"))
    return left, right


@query("""WITH o AS (SELECT 'order:' || o_orderkey AS id, o_orderkey, o_orderdate < TIMESTAMP '2000-01-01' AS l, o_orderkey % 13 != 0 AS r, o_orderkey % 11 = 0 AS c FROM orders)
SELECT id, CASE WHEN NOT l THEN 'added' WHEN NOT r THEN 'removed' ELSE 'modified' END AS change, CASE WHEN l AND r THEN 'title,version' ELSE '' END AS fields FROM o WHERE NOT l AND r OR l AND NOT r OR l AND r AND c""")
def graph_diff_records(spark, folder):
    return lc.record_diff(*_snapshots(spark, folder)).withColumn("fields", F.array_join("fields", ","))


@query("""SELECT 'order:' || o_orderkey AS id, unnest(['title', 'version']) AS field, unnest([o_orderpriority, '1']) AS "left", unnest(['changed', '2']) AS "right" FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey % 13 != 0 AND o_orderkey % 11 = 0""")
def graph_field_changes(spark, folder):
    return lc.field_changes(*_snapshots(spark, folder))


@query("""WITH o AS (SELECT 'order:' || o_orderkey AS id, o_orderkey, o_orderdate < TIMESTAMP '2000-01-01' AS l, o_orderkey % 13 != 0 AS r, o_orderkey % 11 = 0 AS c FROM orders)
SELECT id, CASE WHEN NOT l THEN 'added' WHEN NOT r THEN 'removed' ELSE 'modified' END AS change, CASE WHEN l AND r THEN 'title,version' ELSE '' END AS fields FROM o WHERE NOT l AND r OR l AND NOT r OR l AND r AND c""")
def graph_diff_by_digest(spark, folder):
    left, right = _snapshots(spark, folder)
    return lc.record_diff_by_digest(left, right, lc.bucket_digests(left), lc.bucket_digests(right)).withColumn("fields", F.array_join("fields", ","))


@query("""WITH a AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target FROM lineitem WHERE l_returnflag != 'R')
SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_diff_edges(spark, folder):
    own = table(spark, folder, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("p:"), F.col("l_partkey")).alias("target"), F.lit("has").alias("type"), "l_shipdate", "l_returnflag")
    return lc.edge_diff(own.where("l_shipdate < '1998-01-01'"), own.where("l_returnflag != 'R'")).select("source", "target", "change")


@query("SELECT 'order:' || o_orderkey AS id, o_orderpriority AS title, 'status=' || o_orderstatus AS markers, substr(sha256(o_orderstatus || ' ' || o_custkey), 1, 12) AS content FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def fingerprints(spark, folder):
    return _snapshots(spark, folder)[0].select("id", "fingerprint.title", "fingerprint.markers", "fingerprint.content")


@query(f"WITH {ORDERS_SQL} SELECT count(*) AS record_count, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edge_count FROM r")
def graph_stats(spark, folder):
    return lc.stats(vw.order_records(spark, folder), table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct())


# ---- cursors and outbox ----


def _pages(spark, folder):
    own = table(spark, folder, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("ts").cast("timestamp").alias("edited"))
    marks = own.where("event_id % 2 = 0 AND edited < '2024-01-15'").groupBy(F.col("key").alias("source_key")).agg(F.max("edited").alias("watermark"))
    return own, marks


_CURSOR_SQL = "i AS (SELECT event_id, 'user:' || user_id AS key, ts AS edited FROM events), m AS (SELECT key, max(edited) AS mark FROM i WHERE event_id % 2 = 0 AND edited < TIMESTAMP '2024-01-15' GROUP BY key)"


@query(f"WITH {_CURSOR_SQL} SELECT event_id, coalesce(edited > greatest(mark, TIMESTAMP '2024-01-05'), true) AS fresh FROM i LEFT JOIN m USING (key)")
def cursor_fresh_split(spark, folder):
    own, marks = _pages(spark, folder)
    return cu.with_freshness(own, marks, "key", "edited", "2024-01-05").select("event_id", "fresh")


@query(f"WITH {_CURSOR_SQL}, f AS (SELECT edited, coalesce(edited > mark, true) AS fresh FROM i LEFT JOIN m USING (key)) SELECT count_if(fresh)::BIGINT AS fresh, count_if(NOT fresh)::BIGINT AS stale, max(edited) FILTER (fresh)::VARCHAR AS new_cursor FROM f")
def cursor_hint(spark, folder):
    own, marks = _pages(spark, folder)
    return cu.split_counts(cu.with_freshness(own, marks, "key", "edited"), "edited").withColumn("new_cursor", F.col("new_cursor").cast("string"))


@query("SELECT 'user:' || user_id AS source_key, epoch_us(max(ts)) AS watermark FROM events GROUP BY user_id")
def cursor_advance(spark, folder):
    own, marks = _pages(spark, folder)
    return cu.advanced(marks, own, "key", "edited").withColumn("watermark", F.unix_micros("watermark"))


@query(f"""WITH {ORDERS_SQL}, q AS (SELECT 'order:' || event_id AS id, event_id AS ordinal FROM events), st AS (SELECT id, 'page:' || o_orderkey AS page_id, o_orderkey % 3 AS sent FROM r WHERE o_orderkey % 5 = 0),
j AS (SELECT q.id, q.ordinal, r.type, r.o_orderkey, r.domain, st.page_id, st.sent, r.o_orderkey % 6 = 0 AS pending, (1 + r.o_orderkey % 2)::INT AS revision FROM q LEFT JOIN r USING (id) LEFT JOIN st USING (id)),
k AS (SELECT *, CASE WHEN o_orderkey IS NULL THEN 'missing-from-graph' WHEN type NOT IN ('rule', 'decision', 'task', 'bug') THEN 'non-pushable-type' WHEN pending THEN 'pending-arbitration' WHEN page_id IS NOT NULL AND revision <= sent THEN 'no-revision-change' END AS reason FROM j)
SELECT id, ordinal, CASE WHEN reason IS NOT NULL THEN 'skip' WHEN page_id IS NOT NULL THEN 'update' ELSE 'create' END AS action, reason, page_id, CASE WHEN o_orderkey IS NULL THEN NULL WHEN domain = 'building' THEN 'page:b' ELSE 'page:root' END AS parent_page_id, revision FROM k""")
def push_plan(spark, folder):
    own = vw.order_records(spark, folder).withColumns({"arbiter": F.when(F.col("ingest_ordinal") % 6 == 0, "pending-arbitration").otherwise("deterministic"), "version": (1 + F.col("ingest_ordinal") % 2).cast("int"), "parent": F.concat(F.lit("shop > "), cl.scalar("markers", "domain"))})
    queue = table(spark, folder, "events").select(F.concat(F.lit("order:"), F.col("event_id")).alias("id"), F.col("event_id").alias("ordinal"))
    state = own.where("ingest_ordinal % 5 = 0").select("id", F.concat(F.lit("page:"), F.col("ingest_ordinal")).alias("page_id"), (F.col("ingest_ordinal") % 3).cast("int").alias("revision"))
    return ob.push_plan(queue, own, state, {"building/": "page:b"}, "page:root")


@query(f"WITH {ORDERS_SQL} SELECT id FROM r WHERE type IN ('rule', 'decision', 'task', 'bug')")
def pushable_records(spark, folder):
    return ob.pushable(vw.order_records(spark, folder)).select("id")


# ---- promotion ----

_COHORT = f"{ORDERS_SQL}, l AS (SELECT 'cust:' || o_custkey AS cohort, id, o_orderkey AS ordinal, field, value FROM ({_LONG})), z AS (SELECT 'cust:' || o_custkey AS cohort, count(*) AS members FROM r GROUP BY ALL), fv AS (SELECT cohort, field, value, count(*) AS n, min(ordinal) AS first FROM l GROUP BY ALL)"


@query(f"WITH {_COHORT} SELECT cohort, field, min(value) AS value FROM fv JOIN z USING (cohort) GROUP BY cohort, field HAVING count(*) = 1 AND sum(n) = any_value(members)")
def common_markers(spark, folder):
    return pr.common_markers(vw.cohorts(spark, folder))


@query(f"WITH {_COHORT} SELECT cohort, field, array_to_string(list_sort(list(value)), ',') AS values FROM fv GROUP BY cohort, field HAVING count(*) > 1")
def marker_conflicts(spark, folder):
    return pr.marker_conflicts(vw.cohorts(spark, folder)).withColumn("values", F.array_join("values", ","))


@query(f"WITH {_COHORT} SELECT cohort, value FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY n DESC, first) AS k FROM fv WHERE field = 'status') WHERE k = 1")
def majority_marker(spark, folder):
    return pr.majority(vw.cohorts(spark, folder), "status")


@query(f"WITH {_COHORT} SELECT cohort, (['low', 'medium', 'high', 'critical'])[max(list_position(['low', 'medium', 'high', 'critical'], value))] AS severity FROM l WHERE field = 'severity' GROUP BY cohort")
def strongest_severity(spark, folder):
    return pr.strongest_severity(vw.cohorts(spark, folder))


@query(f"""WITH {_COHORT}, f AS (SELECT cohort, field, count(*) AS kinds, sum(n) AS n FROM fv GROUP BY ALL), g AS (SELECT cohort, count(*) AS considered, count_if(kinds = 1 AND n = members) AS consensus, count_if(kinds > 1) AS conflicts FROM f JOIN z USING (cohort) GROUP BY cohort)
SELECT cohort, considered, consensus::BIGINT AS consensus, conflicts::BIGINT AS conflicts, round((consensus + 0.5::DOUBLE * greatest(considered - consensus - conflicts, 0)) / greatest(considered, 1), 3) AS score, CASE WHEN conflicts = 0 THEN 'safe' WHEN conflicts <= 2 THEN 'review' ELSE 'split' END AS recommendation FROM g""")
def promotion_quality(spark, folder):
    return pr.promotion_quality(vw.cohorts(spark, folder))


@query(f"""WITH {_COHORT}, c AS (SELECT cohort, field AS marker, row_number() OVER (PARTITION BY cohort ORDER BY coalesce(list_position({vw._sql_list(list(pr.SPLIT_ORDER))}, field), 8), field) AS place FROM fv GROUP BY cohort, field HAVING count(*) > 1)
SELECT c.cohort, marker, place::INT AS place, value, n AS group_size, row_number() OVER (PARTITION BY c.cohort, marker ORDER BY n DESC, value)::INT AS group_rank FROM c JOIN fv ON fv.cohort = c.cohort AND fv.field = marker WHERE place <= 3""")
def split_suggestions(spark, folder):
    return pr.split_suggestions(vw.cohorts(spark, folder))


@query(f"""WITH {_COHORT}, t AS (SELECT 'cust:' || o_custkey AS cohort, unnest(tokens) AS keyword FROM r), c AS (SELECT cohort, keyword, count(*) AS n FROM t WHERE len(keyword) > 2 AND keyword NOT IN {tx.STOPWORDS} GROUP BY ALL),
m AS (SELECT c.*, members, max(n) OVER (PARTITION BY cohort) AS most FROM c JOIN z USING (cohort))
SELECT cohort, keyword, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY n DESC, keyword) AS k FROM m WHERE n = members OR most < members) WHERE k <= 8""")
def shared_keywords(spark, folder):
    return pr.shared_keywords(vw.cohorts(spark, folder))


_NEG = ", ".join("'" + n.replace("'", "''") + "'" for n in tx.NEGATIONS)


@query(rf"""WITH w AS (SELECT conv_id AS cohort, turn, regexp_extract_all(regexp_replace(lower(CASE WHEN coalesce(text, '') != '' THEN text ELSE coalesce(role, '') END), '[^a-z0-9\s'']', ' ', 'g'), '\S+') AS t FROM conversations),
e AS (SELECT cohort, turn, i, t[i] AS token FROM w, unnest(range(1, len(t) + 1)) AS u(i)),
k AS (SELECT *, token IN ({_NEG}) AS neg, max(i) FILTER (token NOT IN {tx.STOPWORDS}) OVER (PARTITION BY cohort, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
g AS (SELECT k.cohort, k.turn, k.token, coalesce(p.neg, false) AND NOT k.neg AND k.token NOT IN {tx.STOPWORDS} AS negated FROM k LEFT JOIN k p ON p.cohort = k.cohort AND p.turn = k.turn AND p.i = k.prev),
s AS (SELECT cohort, turn, token, bool_or(NOT negated) AS a, bool_or(negated) AS n FROM g WHERE len(token) >= 4 AND token NOT IN {tx.STOPWORDS} GROUP BY ALL)
SELECT cohort, token, count_if(a AND NOT n)::BIGINT AS affirmative, count_if(n AND NOT a)::BIGINT AS negated FROM s GROUP BY cohort, token HAVING count_if(a AND NOT n) > 0 AND count_if(n AND NOT a) > 0""")
def content_conflicts(spark, folder):
    return pr.content_conflicts(vw.conversation_cohorts(spark, folder))


@query()
def promote_cohorts(spark, folder):
    out = pr.promote(vw.cohorts(spark, folder))
    return out.select("cohort", "id", "title", F.size("relations").alias("n_members"), "quality.score", "quality.recommendation", F.md5("content").alias("content"))


# ---- evaluation ----

_EVAL_SQL = f"""q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')) AS t FROM benchmark), d AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS token FROM documents),
a AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q), s AS (SELECT query_id, id, round(count(*) / any_value(n), 3) AS score FROM a JOIN d USING (token) GROUP BY query_id, id),
ret AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10),
o AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents), oq AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM benchmark),
wd AS (SELECT DISTINCT id, array_to_string(t[i:i + 4], ' ') AS w FROM o, unnest(range(1, len(t) - 3)) AS u(i)), wq AS (SELECT DISTINCT query_id, array_to_string(t[i:i + 4], ' ') AS w FROM oq, unnest(range(1, len(t) - 3)) AS u(i)),
ex AS (SELECT DISTINCT query_id, id FROM wq JOIN wd USING (w) JOIN labels ON doc_id = id WHERE quality = 1),
res AS (SELECT q.query_id, CASE WHEN want = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE hits / n END AS precision, CASE WHEN want = 0 THEN 1.0 ELSE hits / want END AS recall FROM
(SELECT query_id, (SELECT count(*) FROM ret r WHERE r.query_id = q.query_id AND rank <= 5) AS n, (SELECT count(*) FROM ret r JOIN ex USING (query_id, id) WHERE r.query_id = q.query_id AND rank <= 5) AS hits, (SELECT count(DISTINCT id) FROM ex WHERE ex.query_id = q.query_id) AS want FROM q) q)"""


def _evaluated(spark, folder, once=False):
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), tx.tokenize("text").alias("tokens"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), tx.tokenize("text").alias("tokens"))
    found = ev.batch_retrieve(docs, asked, 10)
    found = stored(found, "found") if once else found  # where it is read twice
    good = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    in_order = [table(spark, folder, name).select(F.col(key).alias(own), tx.ordered_tokens("text").alias("tokens")) for name, key, own in (("documents", "doc_id", "id"), ("benchmark", "item_id", "query_id"))]
    wanted = ev.sharing_windows(*in_order).join(good, "id", "left_semi").select("query_id", "id")
    return found, ev.at_k(found, wanted, asked.select("query_id", F.lit(5).alias("k")))


@query(f"WITH {_EVAL_SQL} SELECT query_id, id, score, rank::INT AS rank FROM ret")
def batch_retrieval(spark, folder):
    return _evaluated(spark, folder)[0]


@query(f"WITH {_EVAL_SQL} SELECT query_id, precision::DOUBLE AS precision, recall::DOUBLE AS recall FROM res")
def precision_recall_at_k(spark, folder):
    return _evaluated(spark, folder)[1]


@query(f"""WITH {_EVAL_SQL} SELECT count(*) AS query_count, round(avg(precision), 9) AS mean_precision, round(avg(recall), 9) AS mean_recall,
round((SELECT sum(length(text)) FROM ret JOIN documents ON doc_id = id WHERE rank <= 5) / (count(*) * (SELECT sum(length(text)) FROM documents)), 9) AS pack_ratio FROM res""")
def eval_summary(spark, folder):
    found, results = _evaluated(spark, folder, once=True)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    out = ev.summary(ev.with_sizes(results, found.where("rank <= 5"), docs))
    return out.select("query_count", *[F.round(c, 9).alias(c) for c in ("mean_precision", "mean_recall", "pack_ratio")])


# ---- many queries at once ----

_MODES = (None, *PRESETS)


def _order_queries(spark, folder):
    """A query for each priority and segment, in turn under each mode and none."""
    words = F.regexp_extract("title", "^([0-9]-(?:NOT SPECIFIED|[A-Z]+) [A-Z]+) ", 1)
    own = vw.order_records(spark, folder).select(words.alias("query_id"), *[F.col("markers")[n][0].alias(n) for n in ("severity", "domain")]).distinct()
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.substring("query_id", 1, 1).cast("int") + F.length("query_id")) % len(_MODES) + 1)
    return own.select("query_id", tx.tokenize("query_id").alias("tokens"), F.create_map(F.lit("severity"), "severity", F.lit("domain"), "domain").alias("asked"), mode.alias("mode"))


def _batch_sql() -> str:
    parts = []
    for mode in _MODES:
        intent = PRESETS[mode] if mode else None
        factor = lambda name: intent.table(name) if intent else {}  # noqa: B023, E731
        n = "((severity = qs)::INT + (domain = qd)::INT)"
        boost = f"CASE WHEN {n} = 0 THEN 1.0 ELSE ((severity = qs)::INT * {factor('marker').get('severity', 1.0)}::DOUBLE + (domain = qd)::INT * {factor('marker').get('domain', 1.0)}::DOUBLE) / {n} END"
        base = f"{n} / 2.0::DOUBLE * {boost} * 0.45 + len(list_intersect(tokens, qt)) / len(qt)::DOUBLE * 0.2 + {_cases('severity', rt.SEVERITY, 0.0)}::DOUBLE * 0.15 + {_cases('status', rt.STATUS, rt.OTHER_STATUS)}::DOUBLE * 0.1 + exp(-{_AGE} / 30.0) * 0.1"
        times = f"({_cases('type', factor('type'))})::DOUBLE * ({_cases('status', factor('status'))})::DOUBLE * {factor('set').get('freshness', 1.0)}"
        parts.append(f"SELECT *, {n} + len(list_intersect(tokens, qt)) AS hits, round(({base}) * {times} + 5e-10, 3) AS raw FROM r JOIN q ON q.mode IS NOT DISTINCT FROM {f'{chr(39)}{mode}{chr(39)}' if mode else 'NULL'} WHERE NOT archived")
    half = "CASE type WHEN 'rule' THEN 365 WHEN 'decision' THEN 180 WHEN 'architecture' THEN 180 ELSE 900 END"
    modes = ", ".join(f"'{m}'" if m else "NULL" for m in _MODES)
    return f"""WITH {ORDERS_SQL}, q AS (SELECT DISTINCT o_orderpriority || ' ' || c_mktsegment AS query_id, severity AS qs, domain AS qd, {vw._sql_tokens("o_orderpriority || ' ' || c_mktsegment")} AS qt,
([{modes}])[(substr(o_orderpriority, 1, 1)::INT + length(o_orderpriority || ' ' || c_mktsegment)) % {len(_MODES)} + 1] AS mode FROM r0),
x AS ({" UNION ALL ".join(parts)}), s AS (SELECT query_id, id, o_orderkey, round(raw * pow(0.5, {_AGE} / {half}) + 5e-10, 3) AS score FROM x WHERE hits > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o_orderkey)::INT AS rank FROM s WHERE score > 0) SELECT query_id, id, score, rank FROM k WHERE rank <= 8"""


_LIVES = {"default": 900.0, "task": 900.0, "bug": 900.0, "incident": 900.0}


@query(_batch_sql())
def batch_best(spark, folder):
    return ba.best(vw.order_records(spark, folder), _order_queries(spark, folder), AS_OF, half_lives=_LIVES)


_NOUNS = ("ring", "anvil", "gizmo", "bolt", "gear", "plate", "rod", "widget")
_ASKED = [(f"{noun}:{mode}", noun, mode) for k, noun in enumerate(_NOUNS) for mode in (list(PRESETS)[k % len(PRESETS)],)]


def _frontier_sql(hops: int = 3) -> str:
    def of(mode: str, factor: str, key: str, otherwise: float) -> float:
        return PRESETS[mode].table(factor).get(key, otherwise)

    values = ", ".join(f"('{q}', '{n}', {of(m, 'set', 'hop_cap', hops)}, {of(m, 'set', 'hop_penalty', 0.5)}::DOUBLE, {of(m, 'marker', 'flow', 1.0)}::DOUBLE, {of(m, 'set', 'freshness', 1.0)}::DOUBLE, {vw._sql_list(list(PRESETS[m].table('relation')))})" for q, n, m in _ASKED)
    base = f"""{PARTS_SQL}, {LINKS_SQL}, q(query_id, noun, cap, pen, boost, fresh, rels) AS (VALUES {values}),
own AS (SELECT query_id, cap, pen, rels, id, p_partkey, (flow = noun || '-3')::INT AS m, len(list_intersect(tokens, [noun])) AS t, round(round(((flow = noun || '-3')::INT * boost * 0.45 + len(list_intersect(tokens, [noun])) * 0.2::DOUBLE + 0.025 + exp(-31 / 30.0) * 0.1) * fresh + 5e-10, 3) * pow(0.5, 31 / 1e12) + 5e-10, 3) AS own FROM p0, q),
l0 AS MATERIALIZED (SELECT query_id, id, own AS score, 0 AS hop, [p_partkey::BIGINT] AS disc FROM own WHERE m + t > 0 AND own > 0), f0 AS (SELECT * FROM l0)"""
    for h in range(1, hops + 1):
        base += f""", l{h} AS MATERIALIZED (SELECT query_id, target AS id, score, {h} AS hop, disc FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY disc) AS n FROM (SELECT l.query_id, k.target, round(greatest(o.own * pow(o.pen, {h - 1}), l.score * o.pen) + 5e-10, 3) AS score, list_append(l.disc, k.ordinal::BIGINT) AS disc
FROM l{h - 1} l JOIN links k ON k.source = l.id JOIN own o ON o.id = k.target AND o.query_id = l.query_id AND o.cap >= {h} AND list_contains(o.rels, k.rel) WHERE NOT EXISTS (SELECT 1 FROM f{h - 1} f WHERE f.query_id = l.query_id AND f.id = k.target)) WHERE score > 0) WHERE n = 1),
f{h} AS (SELECT * FROM f{h - 1} UNION ALL SELECT * FROM l{h})"""
    return f"WITH {base} SELECT query_id, id, score, hop FROM f{hops}"


@query(_frontier_sql())
def frontier_modes(spark, folder):
    own = vw.part_records(spark, folder, related=True, typed=True)
    asked = spark.createDataFrame([(q, [n], {"flow": f"{n}-3"}, m) for q, n, m in _ASKED], "query_id string, tokens array<string>, asked map<string,string>, mode string")
    return ba.expanded(own, asked, AS_OF, hops=3, half_lives={"default": 1e12}).select("query_id", "id", "score", "hop")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_changes(spark, folder):
    own = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(own).withColumn("start", F.unix_micros("start"))


def _case(hay: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({hay}, '-{form}-') THEN '{value}'" for form, value in _SHOP.looked_for(name)) + " END"


@query(f"""WITH h AS (SELECT p_partkey, '-' || {SLUG.format("p_type || ' ' || p_name")} || '-' AS h FROM part)
SELECT p_partkey, {_case("h", "artifact")} AS artifact, {_case("h", "flow")} AS flow, {_case("h", "type")} AS type FROM h""")
def query_signals(spark, folder):
    text = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, folder, "part").select("p_partkey", *[cl.inferred_marker(text, n, _SHOP).alias(n) for n in ("artifact", "flow", "type")])


@query(f"""WITH {ORDERS_SQL} SELECT id, nullif(artifact, 'webhook') AS artifact, CASE WHEN artifact = 'webhook' THEN 'webhook' ELSE flow END AS flow, 'fix the #odd thing' AS rest FROM r""")
def hashtag_markers(spark, folder):
    own = vw.order_records(spark, folder).select("id", F.format_string("fix #%s the #odd  #%s thing", F.upper(cl.scalar("markers", "flow")), cl.scalar("markers", "artifact")).alias("text"))
    return own.select("id", F.inline(F.array(cl.hashtags("text", Vocabulary())))).select("id", F.col("known")["artifact"].alias("artifact"), F.col("known")["flow"].alias("flow"), "rest")


@query("""SELECT 'domain' AS field, value FROM (SELECT DISTINCT lower(c_mktsegment) AS value FROM customer WHERE c_mktsegment != 'HOUSEHOLD' UNION SELECT 'payments')
UNION ALL SELECT DISTINCT 'flow', lower(event_type) FROM events""")
def merged_vocabulary(spark, folder):
    from quillgraph.plans.vocabulary import merged

    # accepted proposals and rejected values from tables; both are vocabularies, so small
    segments = sorted(r[0] for r in table(spark, folder, "customer").select(F.lower("c_mktsegment")).distinct().collect())
    events = sorted(r[0] for r in table(spark, folder, "events").select(F.lower("event_type")).distinct().collect())
    own = merged(Vocabulary({"domain": ["payments"]}, {}), {"markers": {"flow": events}}, {"domain": segments}, {"domain": ["household"]})
    return spark.createDataFrame([(n, v) for n, values in own.markers.items() for v in values], "field string, value string")
