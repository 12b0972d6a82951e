"""Chunks that keep their offsets in the original text.

Fixed windows and sentence pieces are native; recursive splitting and packing are sequential
and run as one Arrow function per text. Chunk ids are document#index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loamdex.functions.text import _c, let, matches
from loamdex.session import small_batches, stored

#: Separators from coarse to fine; the empty one is a cut anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "다. ", " ", "")
STRATEGIES = ("fixed", "sentence", "recursive")
#: Texts that are cut at a time, names of documents that are sent to all tasks at most.
TEXTS, NAMED = 64, 200_000


@dataclass(frozen=True)
class ChunkConfig:
    """How texts are cut. Unknown keys fail as arguments do; sizes that can't work fail here."""

    strategy: str = "recursive"
    size: int = 300
    overlap: int = 0
    separators: tuple[str, ...] = SEPARATORS
    k: int = 5

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown chunking strategy {self.strategy!r}")
        if self.size < 1 or self.k < 1 or self.overlap < 0 or self.overlap >= self.size:
            raise ValueError("size and k must be positive and overlap smaller than size")

    def with_(self, **changes) -> ChunkConfig:
        return replace(self, **changes)


def from_character_splitter(chunk_size: int = 4000, chunk_overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> ChunkConfig:
    """A foreign recursive splitter's names and defaults, in characters."""
    return ChunkConfig("recursive", chunk_size, chunk_overlap, separators)


def from_token_splitter(chunk_size: int = 1024, chunk_overlap: int = 20, chars_per_token: float = 4.0) -> ChunkConfig:
    """A foreign sentence splitter's names and defaults, in tokens."""
    return ChunkConfig("sentence", round(chunk_size * chars_per_token), round(chunk_overlap * chars_per_token))


def clamp(size: float, overlap: float) -> tuple[int, int]:
    size = max(1, int(size))
    return size, max(0, min(int(overlap), size - 1))


def fixed_spans(text: Column | str, size: int, overlap: int = 0) -> Column:
    """Windows of size characters that start size - overlap apart; the first that reaches the end is the last."""
    size, overlap = clamp(size, overlap)

    def spans(n: Column) -> Column:
        last = F.greatest(F.ceil((n - size) / (size - overlap)).cast("int"), F.lit(0))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * (size - overlap)).alias("start"), F.least(i * (size - overlap) + size, n).alias("end")))
        return F.when(n > 0, windows).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return let(F.char_length(_c(text)), spans)  # counted once, not for each window


def fixed_chunks(text: Column | str, size: int, overlap: int = 0) -> Column:
    """Array of (start, end, text) of the fixed windows. The text is cut into steps once, and a window is put together from its own, so that no window is looked for from the text's beginning."""
    size, overlap = clamp(size, overlap)
    step = size - overlap
    both = F.struct(matches(text, f"(?s).{{1,{step}}}").alias("p"), fixed_spans(text, size, overlap).alias("s"))
    # not slice(), which copies all steps of the text for each window
    steps = lambda x, i: F.transform(F.sequence(i, F.least(i + -(-size // step), F.size(x["p"])) - 1), lambda j: F.get(x["p"], j))
    body = lambda x, i: F.left(F.array_join(steps(x, i), ""), F.lit(size))
    return let(both, lambda x: F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), body(x, i).alias("text"))))


def _windows(start: int, end: int, size: int, overlap: int) -> list[tuple[int, int]]:
    step, out = size - overlap, []
    while start < end:
        out.append((start, min(start + size, end)))
        if out[-1][1] == end:
            break
        start += step
    return out


def _pack(atoms: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy chunks of up to size; each starts with the last atoms of the one before, up to overlap, as long as the next atom still fits."""
    out, first = [], 0
    for i, (_, end) in enumerate(atoms):
        if i > first and end - atoms[first][0] > size:
            closed = atoms[i - 1][1]
            out.append((atoms[first][0], closed))
            keep = i
            while keep > first and closed - atoms[keep - 1][0] <= overlap and end - atoms[keep - 1][0] <= size:
                keep -= 1
            first = keep
    return out + ([(atoms[first][0], atoms[-1][1])] if atoms else [])


def _recursive(text: str, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Cut after each coarse separator, pieces that are still too long by finer ones, then pack."""
    if end - start <= size:
        return [(start, end)]
    usable = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, end) >= 0), None)
    if usable is None or separators[usable] == "":
        return _windows(start, end, size, overlap)
    separator, finer = separators[usable], separators[usable + 1 :]
    cuts, at = [start], text.find(separator, start)
    while 0 <= at < end:  # a separator may reach over the end
        cuts.append(min(end, at + len(separator)))
        at = text.find(separator, cuts[-1])
    if cuts[-1] < end:
        cuts.append(end)
    atoms = [a for s, e in zip(cuts, cuts[1:]) if e > s for a in (_recursive(text, s, e, size, overlap, finer) if e - s > size else [(s, e)])]
    return _pack(atoms, size, overlap)


def _sentence_cuts(text: str) -> list[tuple[int, int]]:
    import re

    cuts = [m.end() for m in re.finditer(r"[.!?。]+[\"')\]]?(?=\s|\Z)\s*|\n+", text)]
    return [(s, e) for s, e in zip([0, *cuts], [*cuts, len(text)]) if e > s]


def cut(text: str, strategy: str = "recursive", size: float = 300, overlap: float = 0, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of one text; blank ones are dropped."""
    size, overlap = clamp(size, overlap)
    if strategy == "fixed":
        found = _windows(0, len(text), size, overlap)
    elif strategy == "sentence":
        found = _pack([x for s, e in _sentence_cuts(text) for x in (_windows(s, e, size, 0) if e - s > size else [(s, e)])], size, overlap)
    elif strategy == "recursive":
        found = _recursive(text, 0, len(text), size, overlap, separators)
    else:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return [(s, e) for s, e in found if text[s:e].strip()]


def chunk(docs: DataFrame, config: ChunkConfig = ChunkConfig(), id: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """(doc, chunk_id, index, start, end, text[, embed_text]) per chunk: narrow, one row in, its chunks out.

    Blank chunks are dropped before numbering. With title, embed_text is the text with the title in brackets; offsets stay those of the text.
    """
    kept = [F.col(id).alias("doc"), *([F.col(title).alias("_title")] if title else [])]
    names = ["doc", *(["_title"] if title else [])]
    if config.strategy == "fixed":
        made = F.filter(fixed_chunks(text, config.size, config.overlap), lambda c: c["text"].rlike(r"(?U)\S"))
        # texts don't go along with their chunks
        # an outer explode: for others, the optimizer also cuts texts in a filter
        out = docs.select(*kept, made.alias("_c")).select(*names, F.posexplode_outer("_c").alias("index", "_s")).filter("index is not null").select(*names, "index", "_s.*")
    else:
        out = _cut_rows(docs.select(*kept, F.col(text).alias("_text")), config)
    extra = [F.concat(F.lit("["), "_title", F.lit("] "), "text").alias("embed_text")] if title else []
    return out.select("doc", F.concat(F.col("doc").cast("string"), F.lit("#"), F.col("index").cast("string")).alias("chunk_id"), "index", "start", "end", "text", *extra)


def documents_of(docs: DataFrame, found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents whose chunks are found (id), stored; up to NAMED names are sent to the documents."""
    named = stored(found.select(F.regexp_replace("id", r"#[0-9]+\z", "").alias("_d")).distinct())
    return stored(docs.join(F.broadcast(named) if named.count() <= NAMED else named, F.col(id).cast("string") == F.col("_d"), "left_semi"))


def _cut_rows(rows: DataFrame, config: ChunkConfig) -> DataFrame:
    """Arrow. rows with index, start, end and text of each chunk in place of _text, the last column. A few texts are cut at a time, so that a task holds no more than their chunks."""
    small_batches(rows)
    kept = rows.select(*rows.columns[:-1])
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kept.schema]
    schema = pa.schema([*fields, ("index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                of, spans, texts = [], [], []
                for n, value in enumerate(part.columns[-1]):
                    t = value.as_py()
                    found = cut(t, config.strategy, config.size, config.overlap, config.separators) if t is not None else []
                    of += [n] * len(found)
                    spans += [(i, s, e) for i, (s, e) in enumerate(found)]
                    texts += [t[s:e] for s, e in found]
                numbers = [pa.array([x[i] for x in spans], pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in part.columns[:-1]), *numbers, pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(n, IntegerType()) for n in ("index", "start", "end")), StructField("text", StringType())]))


def chunk_stats(chunks: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: count, avg (rounded), min, max, duplicated (share of characters stored again); zeros without chunks."""
    n = F.col("end") - F.col("start")
    per = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("count"), F.floor(F.avg(n) + 0.5).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("_sum"))
    size = docs.select(F.col(id).alias("doc"), F.char_length(text).alias("_len"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return size.join(per, "doc", "left").select("doc", *[zero(c) for c in ("count", "avg", "min", "max")], F.coalesce(F.try_divide(F.greatest(F.col("_sum") - F.col("_len"), F.lit(0)), "_len"), F.lit(0.0)).alias("duplicated"))


def overlap_cost(chunks: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: chunks, doc_chars, chunk_chars, extra (share)."""
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("end") - F.col("start")).alias("chunk_chars"))
    b = docs.agg(F.sum(F.char_length(text)).alias("doc_chars"))
    return a.join(F.broadcast(b)).select("chunks", "doc_chars", "chunk_chars", (F.try_divide("chunk_chars", "doc_chars") - 1).alias("extra"))


def overlap_formula(size: int, overlap: int) -> float:
    return size / (size - overlap) - 1


def quote_spans(docs: DataFrame, quotes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """quotes (doc, quote, ...) with start and end of the first occurrence; quotes that don't occur are dropped."""
    d = docs.select(F.col(id).alias("doc"), F.col(text).alias("_text"))
    found = quotes.join(d, "doc").withColumn("start", F.expr("locate(quote, _text) - 1")).filter("start >= 0")
    return found.withColumn("end", F.col("start") + F.char_length("quote")).drop("_text")


def holders(chunks: DataFrame, located: DataFrame) -> DataFrame:
    """Chunks that meet a located quote: the columns of located, chunk_id, holds (all of it is inside)."""
    c = chunks.select("doc", "chunk_id", F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    met = located.join(c, "doc").filter((F.col("_cs") < F.col("end")) & (F.col("start") < F.col("_ce")))
    return met.withColumn("holds", (F.col("_cs") <= F.col("start")) & (F.col("_ce") >= F.col("end"))).drop("_cs", "_ce")


def survival(docs: DataFrame, quotes: DataFrame, configs: list[ChunkConfig], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per configuration: share of the located quotes that some chunk holds whole."""
    located = quote_spans(docs, quotes, id, text).withColumn("_q", F.xxhash64("doc", "quote"))
    cited = docs.join(located.select(F.col("doc").alias(id)).distinct(), id, "left_semi")
    parts = []
    for c in configs:
        kept = holders(chunk(cited, c, id, text), located).groupBy("_q").agg(F.max("holds").alias("holds"))
        score = located.select("_q").distinct().join(kept, "_q", "left").agg(F.count_if("holds").alias("kept"), F.count(F.lit(1)).alias("quotes"))
        parts.append(score.select(F.lit(c.strategy).alias("strategy"), F.lit(c.size).alias("size"), F.lit(c.overlap).alias("overlap"), "kept", "quotes", F.try_divide("kept", "quotes").alias("rate")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cover(chunks: DataFrame) -> DataFrame:
    """(doc, start, end, n): each document cut at all chunk borders, with the number of chunks over each piece. A sweep: one sort per document, no range join."""
    from pyspark.sql import Window

    edges = chunks.select("doc", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy("doc", "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("doc").orderBy("at")
    pieces = edges.select("doc", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return pieces.filter(F.col("end").isNotNull())
