"""Schemas of the engine's tables. A marker is an array of values; a scalar one has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = "map<string,array<string>>"
RELATIONS = "array<struct<type:string,target:string,confidence:double>>"
RECORD = f"""id string, title string, content string, markers {MARKERS}, relations {RELATIONS},
system string, space string, path string, url string, parent string, last_edited_time timestamp,
version int, updated_at timestamp, arbiter string, regions_used array<string>, tokens array<string>,
archived boolean, ingest_ordinal bigint"""
EDGE = """source string, target string, type string, kind string, confidence double,
matched_markers array<string>, shared_tokens array<string>, created_at timestamp, updated_at timestamp"""
TOKEN_DF = "token string, df bigint"
CURSOR = "source_key string, watermark timestamp"
PROPOSAL = "status string, value string, source string, field string, confidence double"
OUTBOX = "id string, ordinal bigint"
PUSH_STATE = "id string, page_id string, revision int, pushed_at timestamp"
MEETING = "id string, k string"
TABLES = {"records": RECORD, "edges": EDGE, "meeting": MEETING, "token_df": TOKEN_DF, "cursors": CURSOR, "proposals": PROPOSAL, "outbox": OUTBOX, "push_state": PUSH_STATE}

#: What a row of a table is known by; a change replaces or removes all rows of a key.
KEYS = {"records": ["id"], "edges": ["source", "target", "type"], "meeting": ["id"]}
#: Tables of counts, by key and count; a change is a difference to add.
COUNTS = {"token_df": ("token", "df")}


def record_columns() -> list[tuple[str, str]]:
    """(name, type) of the columns of a record."""
    out, depth, start = [], 0, 0
    text = RECORD.replace("\n", " ") + ","
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = text[start:k].strip().partition(" ")
            out.append((name, kind))
            start = k + 1
    return out


def as_records(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a record, null where it has none."""
    return df.select(*[(F.col(n).cast(k) if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in record_columns()])
