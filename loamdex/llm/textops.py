"""Column builders shared by the text operators. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import stored as checkpointed  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators between words are all ASCII characters but digits and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def whole(text: str | Column = "text") -> Column:
    """The text; a null text is the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast path, where lower() does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(lowered: Column) -> Column:
    """Words of an ASCII-lower-cased text, in order, repeats included."""
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, also inside of nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: str | Column = "text") -> Column:
    """With doc_id, tells apart rows whose ids repeat; rows that agree in both have equal results."""
    return F.xxhash64(whole(text))


def left_by_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on (doc_id, text_key); null ids meet each other."""
    r = right.withColumnRenamed("doc_id", "_r_id").withColumnRenamed("_key", "_r_key")
    return left.join(r, left["doc_id"].eqNullSafe(r["_r_id"]) & (left["_key"] == r["_r_key"]), "left").drop("_r_id", "_r_key", "_key")


def sha256_of(joined: Column) -> Column:
    return F.sha2(joined, 256)
