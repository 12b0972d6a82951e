"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 12


def write_json(rows: DataFrame, path: str, mode: str = "overwrite", options: dict | None = None) -> None:
    rows.write.mode(mode).options(**(options or {})).json(path)


def write_text(documents: DataFrame, path: str, column: str = "document", mode: str = "overwrite", most: int | None = None) -> None:
    """A line for each text. most: bytes of a file, in folders file=<task>-<n>; a text that is larger by itself has a file of its own."""
    rows = documents.select(F.col(column).cast("string").alias("value"))
    if most is None:
        return rows.write.mode(mode).text(path)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = 0, 0
        for batch in batches:
            numbers = []
            for own in batch.column(1).to_pylist():
                if size and size + own > most:
                    n, size = n + 1, 0
                size += own
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["value", "task", "n"])

    sized = rows.select("value", (F.octet_length(F.coalesce("value", F.lit(""))) + 1).cast("long").alias("size"), F.spark_partition_id().alias("task"))
    placed = sized.mapInArrow(filled, "value string, task int, n long")
    placed.select("value", F.concat_ws("-", "task", "n").alias("file")).write.mode(mode).partitionBy("file").text(path)


def submission_template(questions: DataFrame) -> DataFrame:
    """(document): one JSON object to fill in, with all questions and empty results. questions (qid, question), a short list."""
    empty = F.array().cast("array<string>")
    item = F.struct(F.col("qid").alias("id"), "question", empty.alias("retrieved"), F.lit("").alias("answer"), empty.alias("citations"))
    system = F.struct(F.lit("recursive 200 / overlap 20").alias("chunking"), F.lit("").alias("embedding"), F.lit("hybrid (BM25 + vector, RRF k=60)").alias("retriever"), F.lit(5).alias("k"), F.lit(None).cast("string").alias("reranker"), F.lit(None).cast("string").alias("llm"))
    rows = questions.agg(F.sort_array(F.collect_list(item)).alias("golden"))
    return rows.select(F.to_json(F.struct(F.lit("").alias("team"), empty.alias("members"), system.alias("system"), "golden", F.lit("").alias("notes")), {"ignoreNullFields": "false"}).alias("document"))


class RowStore:
    """Scoreboard rows in parquet, appended; read() gives the newest MOST_ROWS, none where nothing was written yet."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("saved", F.current_timestamp()).write.mode("append").parquet(self.path)

    def read(self, most: int = MOST_ROWS) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(f"{self.schema}, saved timestamp").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        w = Window.orderBy(F.col("saved").desc())
        newest = rows.orderBy(F.col("saved").desc()).limit(most)
        return newest.withColumn("_n", F.row_number().over(w)).orderBy("_n").drop("_n", "saved")


def text_table(rows: DataFrame, most: int = 50) -> str:
    """Rows as aligned text, numbers to four digits."""
    shown = rows.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    table = [rows.columns, *[[cell(v) for v in r] for r in shown]]
    width = [max(len(r[i]) for r in table) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in table)
