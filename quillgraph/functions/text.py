"""Text functions as columns: slugs, tokens, markdown, negation, redaction.

Patterns are ASCII, so Java and other engines agree on them. All functions give null for null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[a-z0-9][a-z0-9_-]{1,}"
FRONT_MATTER = r"\A---\s*\n((?s:.*?))\n---\s*\n?"
HEADING = r"(?m)^#\s+(.+?)\s*$"
LINK = r"\[[^\]]+\]\(([^)]+)\)"
PAGE_ID = r"(?i)([0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
PATH = r"\b[a-zA-Z0-9._-]+(?:/[a-zA-Z0-9._-]+){1,}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SECRET = r"\b(?:sk|pk|Bearer)[-_A-Za-z0-9]{16,}\b"
NEGATIONS = ("not", "no", "never", "without", "avoid", "stop", "skip", "don't", "dont")
STOPWORDS = ("the", "and", "for", "with", "into", "after", "before", "from", "need", "this", "that", "issue", "bug", "task", "rule", "flow", "design", "record", "notes", "note", "callback")

Text = Column | str


def _c(text: Text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def slugify(text: Text) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ordered_tokens(text: Text) -> Column:
    """All tokens in text order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), 0)


def tokenize(text: Text) -> Column:
    """Distinct tokens, ascending."""
    return F.array_sort(F.array_distinct(ordered_tokens(text)))


def markdown_to_text(text: Text) -> Column:
    """Links as their labels, code without its backticks."""
    unlinked = F.regexp_replace(_c(text), r"\[([^\]]+)\]\(([^)]+)\)", "$1")
    return F.regexp_replace(unlinked, r"`{1,3}([^`]+)`{1,3}", "$1")


def front_matter_block(text: Text) -> Column:
    return F.regexp_extract(_c(text), FRONT_MATTER, 1)


def without_front_matter(text: Text) -> Column:
    return F.regexp_replace(_c(text), FRONT_MATTER, "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^['\"]+|['\"]+$", "")


def front_matter(text: Text) -> Column:
    """``key: value`` lines as a map of arrays; ``[a, b]`` is a list, quotes go, a later key wins.
    Booleans are the strings true and false."""
    lines = F.filter(F.transform(F.split(front_matter_block(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))

    def value_of(line: Column) -> Column:
        value = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        inner = F.trim(F.regexp_extract(value, r"^\[(.*)\]$", 1))
        many = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), _bare))
        one = F.when(F.lower(value).isin("true", "false"), F.lower(value)).otherwise(_bare(value))
        return F.when(value.rlike(r"^\[.*\]$"), many).otherwise(F.array(one))

    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), value_of(x).alias("value")))
    # of equal keys the last: those with an equal key after them are left out
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(numbered, lambda e: ~F.exists(numbered, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def title_of(text: Text, fallback: Text) -> Column:
    """The first level-one heading, else the fallback."""
    found = F.trim(F.regexp_extract(_c(text), HEADING, 1))
    return F.when(found != "", found).otherwise(_c(fallback))


def content_of(text: Text) -> Column:
    """The text without its first level-one heading, trimmed."""
    cut = F.regexp_instr(_c(text), F.lit(HEADING))
    heading = F.regexp_extract(_c(text), HEADING, 0)
    whole = _c(text)
    rest = F.when(cut > 0, F.concat(F.substring(whole, F.lit(1), cut - 1), F.substring(whole, cut + F.length(heading), F.length(whole)))).otherwise(whole)
    return F.regexp_replace(rest, r"\A\s+|\s+\z", "")


def title_from_filename(stem: Text) -> Column:
    """A file's stem without a page id, separators as spaces, words capitalised."""
    cleaned = F.regexp_replace(F.regexp_replace(_c(stem), PAGE_ID, ""), r"\s{2,}", " ")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"^[ _-]+|[ _-]+$", ""), "[-_]", " "))
    return F.when(cleaned != "", F.initcap(cleaned)).otherwise(_c(stem))


def page_id(stem: Text) -> Column:
    found = F.lower(F.regexp_extract(_c(stem), PAGE_ID, 1))
    return F.when(found != "", found)


def link_targets(text: Text) -> Column:
    """Relative .md targets of links, decoded, without fragments."""
    decoded = F.transform(F.regexp_extract_all(_c(text), F.lit(LINK), 1), lambda t: F.coalesce(F.try_url_decode(F.replace(F.trim(t), F.lit("+"), F.lit("%2B"))), F.trim(t)))
    kept = F.filter(decoded, lambda t: (t != "") & ~t.startswith("#") & ~F.lower(t).rlike(r"^(https?://|mailto:|notion://)") & F.lower(t).contains(".md"))
    return F.transform(kept, lambda t: F.split(t, "#")[0])


def negation_tokens(text: Text) -> Column:
    """Array of (token, negated): a negation reaches the next token that isn't a stopword."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9\s']", " "), r"\s+"), lambda t: t != "")
    start = F.struct(F.array().cast("array<struct<token:string,negated:boolean>>").alias("out"), F.lit(False).alias("open"))

    def step(state: Column, token: Column) -> Column:
        negation, stop = token.isin(*NEGATIONS), token.isin(*STOPWORDS)
        negated = state["open"] & ~negation & ~stop
        out = F.concat(state["out"], F.array(F.struct(token.alias("token"), negated.alias("negated"))))
        return F.struct(out.alias("out"), F.when(negation, True).when(state["open"] & ~stop, False).otherwise(state["open"]).alias("open"))

    return F.aggregate(tokens, start, step, lambda state: state["out"])


def strip_secrets(text: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), EMAIL, "[redacted-email]"), SECRET, "[redacted-secret]")


_REDACTORS: list[Callable[[Column], Column]] = []


def register_redactor(function: Callable[[Column], Column]) -> None:
    """Adds a column function that redacts contents of packs, after those added before."""
    _REDACTORS.append(function)


def clear_redactors() -> None:
    _REDACTORS.clear()


def redacted(text: Text) -> Column:
    out = _c(text)
    for function in _REDACTORS:
        out = function(out)
    return out


def has_redactors() -> bool:
    return bool(_REDACTORS)


def path_components(text: Text) -> Column:
    """Slugs of the parts of code paths, with repeats; file extensions and common parts go."""
    parts = F.flatten(F.transform(F.regexp_extract_all(_c(text), F.lit(PATH), 0), lambda p: F.split(p, "/")))
    # a part that is common as it stands goes before its extension is cut
    whole = F.filter(F.transform(parts, F.lower), lambda p: ~slugify(p).isin("", *COMMON_PARTS))
    stems = F.transform(whole, lambda p: slugify(F.when(p.contains("."), F.regexp_extract(p, r"^(.*)\.[^.]*$", 1)).otherwise(p)))
    return F.filter(stems, lambda s: ~s.isin("", *COMMON_PARTS))


# Fixed values.
COMMON_PARTS = ("src", "app", "lib", "modules", "module", "dist", "build", "node_modules", "test", "tests", "spec", "specs", "assets", "public", "utils", "util", "index", "main", "config", "configs", "package", "packages")
BIGRAM_STOPS = (
    "the", "and", "for", "with", "into", "after", "before", "from", "need", "this", "that", "has", "have", "was", "were", "are", "been", "being", "when", "while", "then", "than", "but", "you", "your", "our", "their", "its", "his", "her", "they", "them", "these", "those",
)
