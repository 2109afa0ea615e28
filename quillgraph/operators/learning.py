"""Mining the corpus for vocabulary: document frequencies, hierarchies, bigrams, code paths, importance.

Everything is counted by partial aggregation; proposals leave as rows, and a limit is part of
the definition where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import BIGRAM_STOPS, ordered_tokens, path_components, slugify

LIMIT = 50
SUPPORT = 5


def text_of(title: str = "title", content: str = "content") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(content), F.lit("")))


def token_document_frequency(records: DataFrame, text: Column | None = None) -> DataFrame:
    """(token, df) over the distinct tokens of each record."""
    tokens = F.array_distinct(ordered_tokens(text if text is not None else text_of()))
    return records.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def frequency_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(token, df): what the document frequencies change by where records ``before`` become ``after``; only their texts are read."""
    signed = None
    for records, sign in ((before, -1), (after, 1)):
        part = records.select(F.explode(F.array_distinct(ordered_tokens(text_of()))).alias("token"), F.lit(sign).alias("df"))
        signed = part if signed is None else signed.unionByName(part)
    return signed.groupBy("token").agg(F.sum("df").cast("bigint").alias("df")).where("df != 0")


def corpus_size(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"))


def _least(values: Column, size: int = SUPPORT) -> Column:
    return F.slice(F.array_sort(F.collect_set(values)), 1, size)


def mine_hierarchy(records: DataFrame, least_confidence: float = 0.30) -> DataFrame:
    """value, confidence, support, average_depth, occurrences of breadcrumb segments (``a > b``).

    Needs id and parent. A segment of one record, or the root of all, is no proposal."""
    total = F.broadcast(records.agg(F.count("*").alias("total")))
    parts = F.filter(F.transform(F.split(F.coalesce("parent", F.lit("")), ">"), lambda x: F.trim(x)), lambda p: p != "")
    each = records.select("id", F.posexplode(parts).alias("depth", "part")).select("id", "depth", slugify("part").alias("value")).where("value != ''")
    # records of a segment are counted in two steps, so no set of ids is held
    by_record = each.groupBy("value", "id").agg(F.count("*").alias("n"), F.sum("depth").alias("depths"))
    stats = by_record.groupBy("value").agg(F.count("*").alias("records"), F.sum("n").alias("occurrences"), (F.sum("depths") / F.sum("n")).alias("average_depth"))
    out = stats.join(total).where("total >= 2").withColumn("support", F.col("records") / F.col("total"))
    out = out.where("records >= 2 AND NOT (support = 1.0 AND average_depth = 0.0)")
    confidence = 0.4 * F.col("support") + 0.4 * (1 - F.col("support")) + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("average_depth") / 5.0)
    return out.withColumn("confidence", F.round(confidence, 3)).where(F.col("confidence") >= least_confidence).select("value", "confidence", "support", F.round("average_depth", 2).alias("average_depth"), "occurrences")


def mine_bigrams(records: DataFrame, text: Column | None = None, least_frequency: int = 2, least_confidence: float = 0.50, limit: int | None = LIMIT) -> DataFrame:
    """value (left-right), confidence, doc_freq, pmi of neighbouring tokens, best first."""
    own = records.select(ordered_tokens(text if text is not None else text_of()).alias("tokens"))
    total = F.broadcast(own.agg(F.count("*").alias("n")))
    frequency = own.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    # a pair is one string here, as distinct strings are told apart by hash; tokens have no blanks
    last = F.greatest(F.size("tokens") - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("tokens", F.lit(1), last), F.slice("tokens", F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b)))
    counted = own.where(F.size("tokens") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("doc_freq")).where(F.col("doc_freq") >= least_frequency)
    counted = counted.withColumns({"l": F.substring_index("pair", " ", 1), "r": F.substring_index("pair", " ", -1)}).where(~F.col("l").isin(*BIGRAM_STOPS) & ~F.col("r").isin(*BIGRAM_STOPS))
    kept = counted.join(total).where("doc_freq < n AND n >= 2")
    joined = kept.join(frequency.select(F.col("token").alias("l"), F.col("f").alias("fl")), "l").join(frequency.select(F.col("token").alias("r"), F.col("f").alias("fr")), "r")
    log_n = F.log(F.col("n").cast("double"))
    pmi = F.log(F.col("doc_freq") * F.col("n") / (F.col("fl") * F.col("fr")))
    confidence = F.least(F.lit(1.0), 0.6 * F.col("doc_freq") / F.col("n") + 0.25 * F.log(F.col("n") / F.col("doc_freq")) / log_n + 0.15 * F.greatest(pmi / log_n, F.lit(0.0)))
    out = joined.select(F.concat_ws("-", "l", "r").alias("value"), F.round(confidence, 3).alias("confidence"), "doc_freq", F.round(pmi, 3).alias("pmi")).where(F.col("confidence") >= least_confidence)
    return out if limit is None else out.orderBy(F.desc("confidence"), "value").limit(limit)


def mine_code_paths(records: DataFrame, text: Column | None = None, least: int = 2, limit: int | None = LIMIT) -> DataFrame:
    """value, confidence, occurrences of path components, best first."""
    parts = records.select(F.explode(path_components(text if text is not None else text_of())).alias("value"))
    out = parts.groupBy("value").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    out = out.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.col("occurrences")), 3)).select("value", "confidence", "occurrences")
    return out if limit is None else out.orderBy(F.desc("confidence"), "value").limit(limit)


def marker_importance(records: DataFrame) -> DataFrame:
    """(field, importance): 0.3 presence + 0.4 evenness of values + 0.3 share from explicit regions. Needs markers, regions_used."""
    total = F.broadcast(records.agg(F.count("*").alias("total")))
    explicit = F.arrays_overlap(F.coalesce("regions_used", F.array().cast("array<string>")), F.array(F.lit("frontmatter"), F.lit("metadataBlock")))
    each = records.select(F.explode("markers").alias("field", "value"), explicit.alias("explicit")).where(F.size("value") > 0)
    by_value = each.groupBy("field", F.array_join("value", "\x01").alias("value")).agg(F.count("*").alias("n"), F.count_if("explicit").alias("e"))
    # entropy from sums: log2(N) - sum(n log2 n) / N
    by_field = by_value.groupBy("field").agg(F.sum("n").alias("populated"), F.sum("e").alias("explicit"), F.count("*").alias("values"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    evenness = F.when(F.col("values") <= 1, 0.0).otherwise((F.log2("populated") - F.col("nlogn") / F.col("populated")) / F.log2(F.greatest("values", F.lit(2))))
    return by_field.join(total).select("field", F.round(0.3 * F.col("populated") / F.col("total") + 0.4 * evenness + 0.3 * F.col("explicit") / F.col("populated"), 3).alias("importance"))


def full_pass(records: DataFrame) -> dict[str, DataFrame]:
    """All proposals, as value, source, confidence, and the marker importance."""
    found = {"hierarchy": mine_hierarchy(records).orderBy(F.desc("confidence"), "value"), "ngram": mine_bigrams(records), "code-path": mine_code_paths(records)}
    order = {name: k for k, name in enumerate(found)}
    proposals = None
    for name, df in found.items():
        part = df.select("value", F.lit(name).alias("source"), "confidence", F.lit(order[name]).alias("strategy"))
        proposals = part if proposals is None else proposals.unionByName(part)
    return {"proposals": proposals, "importance": marker_importance(records)}


def unseen_proposals(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """Proposals whose value isn't pending, accepted or rejected yet (known: value); of equal values the first strategy's."""
    fresh = proposals.join(known.select("value"), "value", "left_anti")
    first = fresh.groupBy("value").agg(F.min_by(F.struct("source", "confidence", "strategy"), "strategy").alias("p"))
    return first.select("value", "p.source", "p.confidence", "p.strategy")


def decide(proposals: DataFrame, value: str, decision: str, field: str | None = None) -> DataFrame:
    """The proposals table after accept (for a field), reject or skip; each takes the value from those pending."""
    if decision not in ("accept", "reject", "skip"):
        raise ValueError(f"unknown decision {decision!r}")
    if decision == "accept" and not field:
        raise ValueError("accepting needs a field")
    hit = (F.col("value") == value) & (F.col("status") == "pending")
    if decision == "skip":
        return proposals.where(~hit)
    return proposals.withColumn("field", F.when(hit, F.lit(field)).otherwise(F.col("field"))).withColumn("status", F.when(hit, f"{decision}ed").otherwise(F.col("status")))
