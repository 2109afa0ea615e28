"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in a
text; from each, a deterministic parser that only looks around the anchor expands the
span and validates it. A digit that no group before has reached begins one, of which network
addresses and cards are made. Every parser is linear in the text, also on long runs of digits or at-signs, and positions
are code points.

Base kinds are email, ip, card and phone; ``account`` and ``address`` are added:
account: the value after a cue (account, IBAN, password, token, ...) with at least four
digits, or an IBAN or access key of valid form; address: a street address around its
street word, or a URL that names a user.

Defined results: null is read as empty text and has no spans; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textops import CHUNK_BYTES, slices

KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE = KINDS[:4]
Span = tuple[int, int]

# What the anchors are.
CUES = "account acct iban passport ssn password passwd pwd token api_key apikey secret login user_id customer_id licence_no konto kontonummer compte cuenta".split()
KEY_PREFIXES = ("AKIA", "ASIA")
STREETS = "Street Avenue Road Boulevard Lane Drive Square Court Straße Strasse Weg Platz".split()
SCHEMES = ("://",)
STREET_REACH = 160

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:[ _-]?(?:number|no\.?|nr\.?|num|id|code|key|is|n°)(?![A-Za-z]))?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+.-]{4,}[A-Za-z0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,9}")
_KEY = re.compile(r"[A-Z0-9]{20}(?![A-Za-z0-9])")
#: Of a house number and up to four words; the pattern is shorter than STREET_REACH, so nothing of it lies further left.
_NUMBER_LEFT = re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-ZÄÖÜ][\w'-]{1,30} ){1,4}\Z")
_NAMES_USER = re.compile(r"[?&](?:user|username|email|mail|login|phone|token|key)=|/~")
_URL_END = re.compile(r"[ \t\n\r\v\f<>\"']|\Z")
_HOST_END = re.compile(r"[/?#]|\Z")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ("@",)), ("+", ("+",)), ("digit", tuple("0123456789")), ("scheme", SCHEMES), ("key", KEY_PREFIXES), ("street", STREETS), ("cue", [v for c in CUES for v in {c, c.upper(), c.capitalize()}])):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _email(text: str, at: int, free: int) -> Span | None:
    """The address around the at-sign, not reaching back over ``free``."""
    right = _DOMAIN.match(text, at + 1)
    if right is None:
        return None
    start = at
    while start > free and _LOCAL.match(text, start - 1):
        start -= 1
    return (start, right.end()) if start < at else None


class _Digits:
    """Addresses and cards from the first digits of groups, in the order of the text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.free, self.card_free = 0, 0
        self.chain: list[Span] = []

    def ip(self, begin: int) -> Span | None:
        """The address that a group ends: four groups joined by dots, counted from the left of each chain."""
        group = _DIGITS.match(self.text, begin).span()
        self.free = group[1]
        if self.chain and not (begin == self.chain[-1][1] + 1 and self.text[begin - 1] == "."):
            self.chain = []
        self.chain.append(group)
        if len(self.chain) < 4:
            return None
        parts, self.chain = self.chain, []
        small = all(len(p := self.text[a:b].lstrip("0")) < 4 and int(p or 0) < 256 for a, b in parts)
        return (parts[0][0], parts[3][1]) if small else None

    def card(self, begin: int) -> Span | None:
        if begin < self.card_free or (m := _CARD.match(self.text, begin)) is None:
            return None
        self.card_free = m.end()
        valid = m.end() - begin < 40 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits)
        return m.span() if valid else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, begin: int, end: int, seen: dict[str, int]) -> Span | None:
    """The value after a cue at begin:end, to its end. Of a value that a cue before has been followed
    by, which ends at seen["value"], the rest isn't looked at again: it is in that span, or has too few digits too."""
    if begin and (text[begin - 1].isalnum()) or text[end : end + 1].isalpha():
        return None
    at = _AFTER_CUE.match(text, end).end()
    if at == end:
        return None
    if (m := _IBAN.match(text, at)) and iban(m[0]):
        return m.span()
    if at < seen.get("value", 0) or (m := _VALUE.match(text, at)) is None:
        return None
    seen["value"] = m.end()
    return m.span() if sum(c.isdigit() for c in m[0]) >= 4 else None


def _street(text: str, begin: int, end: int, seen: dict[str, int]) -> Span | None:
    if text[end : end + 1].isalnum():
        return None
    left = _NUMBER_LEFT.search(text, max(0, begin - STREET_REACH), begin)
    return (left.start(), end) if left else None


def _url(text: str, begin: int, seen: dict[str, int]) -> Span | None:
    """A URL around its ``://`` that names a user, to its end. URLs within one another end together, at
    seen["url"]; where seen["named"] is that end too, the outer one has a user or no parameter names any."""
    start = begin
    while start and begin - start < 12 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if start == begin:
        return None
    if begin >= seen.get("url", 0):
        seen["url"] = _URL_END.search(text, begin + 3).start()
    end = seen["url"]
    if "@" in text[begin + 3 : _HOST_END.search(text, begin + 3, end).start()]:
        return start, end
    if seen.get("named") == end:
        return None
    seen["named"] = end
    return (start, end) if _NAMES_USER.search(text, begin, end) else None


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of KINDS, then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    free, phone_free = 0, 0
    seen: dict[str, int] = {}
    digits = _Digits(text)
    for last, (kind, size) in automaton.iter(text):
        begin, end = last + 1 - size, last + 1
        if kind == "digit":
            if begin >= digits.free:
                found["card"] += filter(None, (digits.card(begin),))
                found["ip"] += filter(None, (digits.ip(begin),))
        elif kind == "@":
            if span := _email(text, begin, free):
                found["email"].append(span)
                free = span[1]
        elif kind == "+":
            if begin >= phone_free and (m := _PHONE.match(text, begin)):
                phone_free = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "key":
            if (m := _KEY.match(text, begin)) and not text[max(0, begin - 1) : begin].isalnum():
                found["account"].append(m.span())
        elif span := {"cue": _account, "street": _street}[kind](text, begin, end, seen) if kind != "scheme" else _url(text, begin, seen):
            found["account" if kind == "cue" else "address"].append(span)
    out = []
    for kind in KINDS:
        free = 0
        for start, end in sorted(found[kind]):
            if start >= free:
                out.append((kind, start, end))
                free = end
    return out


def _scan(texts: pa.Array) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    automaton = _automaton()
    for _, part in slices(texts, CHUNK_BYTES):
        for text in part.to_pylist():
            yield text or "", find(text, automaton) if text else []


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "struct<" + ",".join(f"n_{k}:bigint" for k in KINDS) + ",base_sha256:string,spans:string>"


def spans(text: str = "text") -> Column:
    """A struct of the number of spans of each kind, the digest of the base ones, and all of them."""

    @F.arrow_udf(FOUND)
    def spans_of(texts: pa.Array) -> pa.Array:
        rows = []
        for _, found in _scan(texts):
            row: dict[str, object] = {f"n_{k}": sum(x[0] == k for x in found) for k in KINDS}
            row["base_sha256"] = hashlib.sha256(joined([x for x in found if x[0] in BASE]).encode()).hexdigest()
            row["spans"] = joined(found)
            rows.append(row)
        names = [f"n_{k}" for k in KINDS]
        return pa.StructArray.from_arrays([*[pa.array([r[x] for r in rows], pa.int64()) for x in names], *[pa.array([r[x] for r in rows], pa.string()) for x in ("base_sha256", "spans")]], names=[*names, "base_sha256", "spans"])

    return spans_of(F.col(text))


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind; of overlapping spans the first names the whole."""
    out, at, open_ = [], 0, 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= open_:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        at = open_ = max(at, end)
    return "".join([*out, text[at:]])


def masked(text: str = "text") -> Column:
    """The whole text with personal data replaced; null stays null."""

    @F.arrow_udf("string")
    def mask_of(texts: pa.Array) -> pa.Array:
        out = [mask(t, found) if found else t for t, found in _scan(texts)]
        return pa.array([None if null else t for t, null in zip(out, texts.is_null().to_pylist(), strict=True)], pa.string())

    return mask_of(F.col(text))


def op2_pii_anchors(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", spans("text").alias("s")).select("doc_id", *[F.col(f"s.n_{k}").alias(f"n_{k}") for k in BASE], "s.base_sha256", "s.spans", "s.n_account", "s.n_address")
