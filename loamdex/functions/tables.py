"""Table functions for SQL: a text in, a row for each of its parts out. With LATERAL they stand beside the table that the text is in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loamdex.operators.chunking import _sentence_cuts, cut

SPAN = "index: int, start: int, end: int, text: string"


@F.udtf(returnType=SPAN)
class TextChunks:
    """text_chunks(text, strategy, size, overlap): the spans of chunking by any strategy, blank ones left out. No rows for a null text."""

    def eval(self, text: str, strategy: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (start, end) in enumerate(cut(text, strategy, size, overlap) if text else ()):
            yield i, start, end, text[start:end]


@F.udtf(returnType=SPAN)
class TextSentences:
    """text_sentences(text): sentences with the blanks behind them; together they are the text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (start, end) in enumerate(_sentence_cuts(text) if text else ()):
            yield i, start, end, text[start:end]


@F.udtf(returnType="index: int, word: string, count: int")
class TextWords:
    """text_words(text, most): its most frequent words in lower case, equal ones in alphabetical order."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        import re
        from collections import Counter

        found = Counter(re.findall(r"[^\W_]+", text.lower()) if text else ())
        for i, (word, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]):
            yield i, word, n


FUNCTIONS = {"text_chunks": TextChunks, "text_sentences": TextSentences, "text_words": TextWords}


def register(spark: SparkSession) -> SparkSession:
    """Makes the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    return spark
