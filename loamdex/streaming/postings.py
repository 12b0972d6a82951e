"""Keeping a keyword index up to date from a stream of texts, and counting events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex.functions.text import tokenize
from loamdex.operators.deltas import ChangingIndex, changed, last_changes, summed
from loamdex.operators.retrieval import Bm25Index
from loamdex.session import stored


def append_postings(texts: DataFrame, folder: str, checkpoint: str, id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Writes postings and sizes of each batch under its own number, so a batch that runs again replaces itself. folder must be shared by all executors."""

    def write(batch: DataFrame, number: int) -> None:
        index = Bm25Index.build(batch, id, text)
        index.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        index.size.write.mode("overwrite").parquet(f"{folder}/sizes/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_index(spark: SparkSession, folder: str) -> Bm25Index:
    """The index over all batches so far; frequencies are counted from the postings when first used."""
    postings = spark.read.parquet(f"{folder}/postings").drop("batch")
    size = spark.read.parquet(f"{folder}/sizes").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return Bm25Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), size, tokenizer=tokenize)


_ROWS, _SIZES = "term string, id {0}, tf long, len int, sign long", "id {0}, len int, sign long"


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()]


def _batches(spark: SparkSession, folder: str, id: str, before: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Signed postings and sizes of the changes so far (before a batch), and the last batch that a whole compaction took in."""
    upto = max((int(f.split("upto=")[1].split("/")[0]) for f in _found(spark, f"{folder}/compact/upto=*/sizes/_SUCCESS")), default=-1)
    read = []
    for name, schema in (("rows", _ROWS.format(id)), ("sizes", _SIZES.format(id))):
        rows = spark.createDataFrame([], schema)
        if upto >= 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/compact/upto={upto}/{name}"))
        if _found(spark, f"{folder}/{name}/batch=*"):
            later = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}").filter(F.col("batch") > upto)
            rows = rows.unionByName((later if before is None else later.filter(F.col("batch") < before)).drop("batch"))
        read.append(rows)
    return read[0], read[1], upto


def append_changes(changes: DataFrame, folder: str, checkpoint: str, id: str = "doc_id") -> StreamingQuery:
    """Keeps an index of texts that come, change and go, from a stream of changes (op, doc_id, text, seq).

    Each batch takes the last change of each id, and writes signed postings against what the batches before it
    left under its own number: a batch that runs again replaces itself. folder must be shared by all executors.
    """
    kind = changes.schema[id].dataType.simpleString()

    def write(batch: DataFrame, number: int) -> None:
        rows, sizes, upto = _batches(batch.sparkSession, folder, kind, number)
        if number > upto:  # else a compaction has taken it in
            new_rows, new_sizes = changed(summed(rows), sizes.groupBy("id", "len").agg(F.sum("sign").alias("sign")).filter("sign <> 0"), stored(last_changes(batch, id=id)))
            # both from the state before this batch, then over what an earlier run of it left
            new_rows, new_sizes = stored(new_rows), stored(new_sizes)
            new_rows.withColumn("sign", F.col("sign").cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            new_sizes.withColumn("sign", F.col("sign").cast("long")).write.mode("overwrite").parquet(f"{folder}/sizes/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changing_index(spark: SparkSession, folder: str, id: str = "long") -> ChangingIndex:
    """The index over all changes so far; id is the type of ids."""
    rows, sizes, _ = _batches(spark, folder, id)
    return ChangingIndex(rows, sizes)


def compact_changes(spark: SparkSession, folder: str, upto: int, id: str = "long") -> None:
    """Adds up the batches to upto; what they wrote is no longer read. Until all of it is written, the old state holds."""
    rows, sizes, _ = _batches(spark, folder, id, upto + 1)
    done = ChangingIndex(rows, sizes).compact()
    for name, df in (("rows", done.rows), ("sizes", done.sizes)):  # sizes last: their mark makes it count
        df.write.mode("overwrite").parquet(f"{folder}/compact/upto={upto}/{name}")


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, value) of each window, in a stream once it is final."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
