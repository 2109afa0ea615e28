"""Classification: regions of a text, scores of vocabulary values, arbitration.

All of it is columns of one row, so it runs inside the scan; the vocabulary is literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import FRONT_MATTER, markdown_to_text, ordered_tokens, slugify, tokenize, words
from quillgraph.plans.vocabulary import HASHTAG, Vocabulary

# Fixed values.
REGIONS = {"frontmatter": 5.0, "metadataBlock": 4.0, "titleText": 3.0, "breadcrumb": 2.0, "body": 1.0}
HIGH, GAP, LEAST = 0.75, 0.15, 0.20
METADATA_BLOCK = r"(?ms)^\s*#{1,3}\s*(?:Metadata|Метадані|Метаданные|Метаданы)\s*\n(.*?)(?=^\s*#|\z)"


def regions(title: str = "title", content: str = "content", parent: str = "parent") -> Column:
    """A map of region name to text: front matter and a metadata block are cut out of the body."""
    text = F.coalesce(F.col(content), F.lit(""))
    front = F.trim(F.regexp_extract(text, FRONT_MATTER, 1))
    rest = F.regexp_replace(text, FRONT_MATTER, "")
    block = F.trim(F.regexp_extract(rest, METADATA_BLOCK, 1))
    at = F.regexp_instr(rest, F.lit(METADATA_BLOCK))
    found = F.regexp_extract(rest, METADATA_BLOCK, 0)
    body = F.when(at > 0, F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(found), F.length(rest)))).otherwise(rest)
    values = [front, block, F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(parent), F.lit("")), F.regexp_replace(body, r"\A\s+|\s+\z", "")]
    return F.create_map(*[x for name, value in zip(REGIONS, values, strict=True) for x in (F.lit(name), value)])


def reference_idf(token_df: DataFrame | None, vocabulary: Vocabulary) -> tuple[dict[str, float], float, float]:
    """(weight by token, weight of other tokens, largest weight). The corpus size is the largest
    document frequency, so a token of most documents weighs 0. Only tokens that stand for a
    vocabulary value are looked up, so what reaches the driver is bounded by the vocabulary."""
    if token_df is None:
        return {}, 1.0, 1.0
    most, least = token_df.agg(F.max("df"), F.min("df")).first()
    if not most:
        return {}, 1.0, 1.0
    forms = sorted({f for n, values in vocabulary.markers.items() for v in values for f in vocabulary.forms(n, v)})
    rows = token_df.where(F.translate("token", "_", "-").isin(*forms)).collect()
    return {r["token"]: math.log(most / max(r["df"], 1)) for r in rows}, math.log(most), max(math.log(most / max(least, 1)), 1.0)


def _hits(regions_: str, forms: list[str], idf: tuple[dict[str, float], float, float]) -> Column:
    """Array of (slug, w): the tokens of all regions whose slug is one of the forms, in order."""
    weights, default, _ = idf
    weight_map = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))]) if weights else None

    def of(region: str, weight: float) -> Column:
        one = (lambda t: F.coalesce(weight_map[t], F.lit(default))) if weight_map is not None else (lambda t: F.lit(default))
        slugs = F.transform(ordered_tokens(F.col(regions_)[region]), lambda t: F.struct(slugify(t).alias("slug"), (one(t) * weight).alias("w")))
        return F.filter(slugs, lambda h: F.array_contains(words(*forms), h["slug"]))

    return F.concat(*[of(r, w) for r, w in REGIONS.items()])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where lambdas refer to it; as it stands in a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entries(vocabulary: Vocabulary) -> list[tuple[str, str, int, list[str]]]:
    return [(n, v, i, vocabulary.forms(n, v)) for n, values in vocabulary.markers.items() for i, v in enumerate(values)]


def _total(hits: Column, idf: tuple[dict[str, float], float, float]) -> Column:
    return F.round(F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["w"]) / (sum(REGIONS.values()) * idf[2]), 4)


def scores(regions_: str, vocabulary: Vocabulary, idf: tuple[dict[str, float], float, float] = ({}, 1.0, 1.0)) -> Column:
    """Array of (field, value, score, matched, ordinal) for every allowed value."""
    entries = _entries(vocabulary)
    table = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(v).alias("value"), F.lit(i).alias("ordinal"), words(*forms).alias("forms")) for n, v, i, forms in entries])

    def scored(entry: Column, hits: Column) -> Column:
        own = F.filter(hits, lambda h: F.array_contains(entry["forms"], h["slug"]))
        return F.struct(entry["field"].alias("field"), entry["value"].alias("value"), _total(own, idf).alias("score"), (F.size(own) > 0).alias("matched"), entry["ordinal"].alias("ordinal"))

    return _once(_hits(regions_, sorted({f for *_, forms in entries for f in forms}), idf), lambda hits: F.transform(table, lambda e: scored(e, hits)))


def matched_scores(regions_: str, vocabulary: Vocabulary, idf: tuple[dict[str, float], float, float] = ({}, 1.0, 1.0)) -> Column:
    """What ``scores`` has of the values that match, as (field, value, score): the work goes with the matches, not with the vocabulary."""
    meant: dict[str, list[Column]] = {}
    for n, v, i, forms in _entries(vocabulary):
        for form in forms:
            meant.setdefault(form, []).append(F.struct(F.lit(n).alias("field"), F.lit(v).alias("value"), F.lit(i).alias("ordinal")))
    if not meant:
        return F.array().cast("array<struct<field:string,value:string,score:double>>")
    table = F.create_map(*[x for form, of in meant.items() for x in (F.lit(form), F.array(*of))])
    hits = F.flatten(F.transform(_hits(regions_, sorted(meant), idf), lambda h: F.transform(table[h["slug"]], lambda e: F.struct(e.alias("of"), h["w"].alias("w")))))

    def scored(of: Column, hits: Column) -> Column:
        return F.struct(of["field"].alias("field"), of["value"].alias("value"), _total(F.filter(hits, lambda h: h["of"] == of), idf).alias("score"))

    return _once(hits, lambda found: F.transform(F.array_distinct(F.transform(found, lambda h: h["of"])), lambda of: scored(of, found)))


def top_candidates(matched: str, field: str, vocabulary: Vocabulary, limit: int = 5) -> Column:
    """The best values of a field as (value, score, matched): those of ``matched_scores`` by score, then by value; then the others by value."""
    own = F.filter(F.col(matched), lambda s: s["field"] == field)
    ordered = F.array_sort(F.transform(own, lambda s: F.struct((-s["score"]).alias("a"), s["value"].alias("value"), s["score"].alias("score"))))
    first = F.transform(ordered, lambda s: F.struct(s["value"].alias("value"), s["score"].alias("score"), F.lit(True).alias("matched")))
    others = F.filter(words(*sorted(vocabulary.markers[field])), lambda v: ~F.exists(F.col(matched), lambda s: (s["field"] == field) & (s["value"] == v)))
    return F.slice(F.concat(first, F.transform(others, lambda v: F.struct(v.alias("value"), F.lit(0.0).alias("score"), F.lit(False).alias("matched")))), 1, limit)


def arbitrated(candidates: Column) -> Column:
    """(arbiter, value, score, gap) of a field's candidates; a pending value is set all the same."""
    top = F.coalesce(F.try_element_at(candidates, F.lit(1))["score"], F.lit(0.0))
    gap = F.round(top - F.coalesce(F.try_element_at(candidates, F.lit(2))["score"], F.lit(0.0)), 4)
    arbiter = F.when(top < LEAST, "fallback").when((top >= HIGH) & (gap >= GAP), "deterministic").otherwise("pending-arbitration")
    value = F.when(top >= LEAST, F.try_element_at(candidates, F.lit(1))["value"])
    return F.struct(arbiter.alias("arbiter"), value.alias("value"), top.alias("score"), F.when(top >= LEAST, gap).otherwise(0.0).alias("gap"))


def normalized_markers(markers: str, vocabulary: Vocabulary) -> Column:
    """Values by their slugs: aliases as canonical values, allowed spellings kept, empty ones dropped."""
    rows = sorted((f"{name}\x00{form}", value) for (name, form), value in vocabulary.canonical.items())
    table = F.create_map(*[F.lit(x) for row in rows for x in row]) if rows else None

    def one(name: Column, value: Column) -> Column:
        return F.coalesce(table[F.concat(name, F.lit("\x00"), slugify(value))], slugify(value)) if table is not None else slugify(value)

    kept = F.map_filter(F.coalesce(F.col(markers), F.create_map().cast("map<string,array<string>>")), lambda k, v: v.isNotNull() & F.exists(v, lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.transform_values(kept, lambda k, v: F.transform(F.filter(v, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: one(k, x)))


def scalar(markers: str | Column, field: str) -> Column:
    """The first value of a marker, or null."""
    column = F.col(markers) if isinstance(markers, str) else markers
    return F.try_element_at(column[field], F.lit(1))


def hierarchy(markers: str, vocabulary: Vocabulary) -> Column:
    """(segments, path) of the present markers in the vocabulary's order."""
    segments = F.array_compact(F.array(*[F.when(F.size(F.coalesce(F.col(markers)[n], F.array().cast("array<string>"))) > 0, F.array_join(F.col(markers)[n], ", ")) for n in vocabulary.hierarchy]))
    return F.struct(segments.alias("segments"), F.array_join(segments, vocabulary.separator).alias("path"))


def record_id(df: DataFrame) -> Column:
    """An explicit id, else one of the source's place, else one of the title."""
    def col(n: str) -> Column:
        return F.when(F.col(n) != "", F.col(n)) if n in df.columns else F.lit(None).cast("string")

    place = F.coalesce(col("path"), col("url"))
    of_source = F.when(place.isNotNull(), F.concat(F.lit("src:"), slugify(F.concat_ws("::", col("system"), col("space"), place))))
    of_title = F.concat(F.lit("record:"), slugify(F.coalesce(col("title"), F.lit("untitled"))))
    return F.coalesce(col("id"), of_source, of_title)


def _made(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def classify(records: DataFrame, vocabulary: Vocabulary | None = None, token_df: DataFrame | None = None) -> DataFrame:
    """records with ids, completed markers, missing_required, hierarchy, tokens, regions_used, arbiter and candidates.

    A record that came as pending-arbitration stays so."""
    vocabulary = vocabulary or Vocabulary()
    idf = reference_idf(token_df, vocabulary)
    for name, kind in (("parent", "string"), ("content", "string"), ("title", "string"), ("markers", "map<string,array<string>>"), ("arbiter", "string")):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    # by id: a file of a few MB is one task, and a row costs far more than its bytes
    out = records.withColumn("id", record_id(records)).repartition("id")
    out = _made(_made(out, "_regions", regions()), "_given", normalized_markers("markers", vocabulary))
    # each step behind a generator, as it is used several times and must be made once
    out = _made(out, "_scores", matched_scores("_regions", vocabulary, idf))
    open_ = F.array_compact(F.array(*[F.when(~F.map_contains_key(F.col("_given"), n), F.struct(F.lit(n).alias("field"), top_candidates("_scores", n, vocabulary).alias("candidates"))) for n in vocabulary.markers]))
    out = _made(out, "candidates", open_)
    out = _made(out, "_decided", F.transform("candidates", lambda d: F.struct(d["field"].alias("field"), _once(d["candidates"], arbitrated).alias("d"))))
    chosen = F.filter("_decided", lambda d: d["d"]["value"].isNotNull())
    filled = F.map_from_entries(F.transform(chosen, lambda d: F.struct(d["field"].alias("key"), F.array(d["d"]["value"]).alias("value"))))
    out = out.withColumn("markers", F.map_concat("_given", filled))
    pending = F.exists("_decided", lambda d: d["d"]["arbiter"] == "pending-arbitration") | (F.coalesce("arbiter", F.lit("")) == "pending-arbitration")
    out = out.withColumn("arbiter", F.when(pending, "pending-arbitration").when(F.size("markers") > 0, "deterministic").otherwise("fallback"))
    tokens = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("_regions"), lambda r: tokenize(markdown_to_text(r))))))
    return out.withColumns(
        {
            "missing_required": F.filter(words(*vocabulary.required), lambda n: ~F.map_contains_key(F.col("markers"), n)),
            "hierarchy": hierarchy("markers", vocabulary),
            "tokens": tokens,
            "regions_used": F.map_keys(F.map_filter("_regions", lambda k, v: v != "")),
        }
    ).drop("_regions", "_given", "_scores", "_decided")


def arbitration_requests(classified: DataFrame, vocabulary: Vocabulary | None = None, preview: int = 2000) -> DataFrame:
    """What a person or a model needs to settle pending fields: id, field, candidates, allowed values, text preview."""
    vocabulary = vocabulary or Vocabulary()
    allowed = F.create_map(*[x for n, v in vocabulary.markers.items() for x in (F.lit(n), words(*v))])
    each = classified.select("id", "title", F.left("content", F.lit(preview)).alias("preview"), F.inline("candidates"))
    decided = each.withColumn("d", arbitrated(F.col("candidates"))).where("d.arbiter = 'pending-arbitration'")
    return decided.select("id", "title", "preview", "field", "candidates", allowed[F.col("field")].alias("allowed_values"), "d.score", "d.gap")


def inferred_marker(text: Column, name: str, vocabulary: Vocabulary) -> Column:
    """The first value, then the first alias, whose slug stands in the text's slug between hyphens."""
    hay = F.concat(F.lit("-"), slugify(text), F.lit("-"))
    values = [F.when(hay.contains(f"-{form}-"), F.lit(value)) for form, value in vocabulary.looked_for(name)]
    return F.coalesce(*values, F.lit(None).cast("string"))


def hashtags(text: str | Column, vocabulary: Vocabulary) -> Column:
    """(known: marker by field, unknown tags, rest: the text without the known tags) of ``#value`` tags. A value of several
    fields is the first one's; the last tag of a field wins."""
    column = F.col(text) if isinstance(text, str) else text
    field_of = {value.lower(): name for name, values in reversed(vocabulary.markers.items()) for value in values}
    table = F.create_map(*[F.lit(x) for pair in field_of.items() for x in pair])
    tags = F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(HASHTAG.pattern), 0), lambda t: F.substring(t, 2, 1 << 30))
    told = F.filter(F.transform(tags, lambda t: F.struct(table[F.lower(t)].alias("field"), F.lower(t).alias("value"))), lambda e: e["field"].isNotNull())
    last = F.aggregate(told, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["field"]), F.create_map(e["field"], e["value"])))
    words_ = F.transform(F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.when(w.rlike("^(?:" + HASHTAG.pattern + ")$") & table[F.lower(F.substring(w, 2, 1 << 30))].isNotNull(), F.lit("")).otherwise(w))
    return F.struct(last.alias("known"), F.filter(tags, lambda t: table[F.lower(t)].isNull()).alias("unknown"), F.array_join(F.filter(words_, lambda w: w != ""), " ").alias("rest"))
