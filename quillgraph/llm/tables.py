"""Reading the given tables, keys of texts and rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.tables import LOCAL_SHARED, drop_stored, shared_folder, stored  # noqa: F401
from quillgraph.llm.textops import slices

def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def per_block(function, texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """function over blocks of at most ``limit`` bytes of the texts."""
    for _, part in slices(texts, limit):
        yield function(part)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that columns added beside it can't clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_key(text: str | Column = "text") -> Column:
    """A 128-bit key of the whole text, the same for byte-equal texts; null for null."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))
