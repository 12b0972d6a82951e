"""Keyword search that skips what can't reach the k best.

Texts lie in blocks of about as many ids; a term's postings in one block are one row, with the largest
impact (a posting's score without its idf) among them. The sum of these over a query's terms bounds every
score in the block. A query's rarest terms, RARE postings of them, point at texts that score well; the blocks
of the best of these are scored whole, and their k-th best score is a threshold: of the other blocks only
those whose bound reaches it are read. Larger blocks make fewer bounds and looser ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators.retrieval import DIGITS, Bm25Index, top_k
from loamdex.session import stored


@dataclass
class ImpactIndex:
    """blocks (term, block, most, postings of (id, impact)), weights (term, df, idf), one row each for a term."""

    blocks: DataFrame
    weights: DataFrame
    tokenizer: object

    #: Texts in a block; postings of rare terms, and texts whose blocks are scored for the threshold, for each wanted result.
    TEXTS, RARE, FIRST = 8, 64, 4

    @staticmethod
    def build(index: Bm25Index, block: Column | None = None) -> ImpactIndex:
        """From an index whose settings hold from now on. block: which block an id lies in; by its hash, in blocks of about TEXTS texts, where nothing is given."""
        weights = index.idf()
        size = index.size.select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avg"))
        if block is None:
            block = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("n") / ImpactIndex.TEXTS), F.lit(1)))
        impact = F.col("tf") * (index.k1 + 1) / (F.col("tf") + index.k1 * (1 - index.b + index.b * F.col("len") / F.col("avg")))
        rows = index.postings.join(F.broadcast(size)).select("term", block.alias("block"), "id", impact.alias("impact"))
        blocks = rows.groupBy("term", "block").agg(F.max("impact").alias("most"), F.collect_list(F.struct("id", "impact")).alias("postings"))
        return ImpactIndex(stored(blocks), stored(weights.select("term", "df", "idf")), index.tokenizer)

    def bounds(self, queries: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
        """(qid, block, bound) of the blocks that hold any term of a query: no text in them scores more."""
        met = self._asked(queries, qid, question).join(self.blocks.select("term", "block", "most"), "term")
        return met.groupBy("qid", "block").agg(F.round(F.sum(F.col("idf") * F.col("most")), DIGITS).alias("bound"))

    def _asked(self, queries: DataFrame, qid: str, question: str) -> DataFrame:
        return Bm25Index.terms(queries, qid, question, self.tokenizer).join(self.weights, "term")

    @staticmethod
    def _scores(met: DataFrame) -> DataFrame:
        """(qid, block, id, score) from postings of blocks; no score of a text without any weight."""
        each = met.select("qid", "block", F.col("idf").alias("w"), F.explode("postings").alias("p")).select("qid", "block", "p.id", (F.col("w") * F.col("p.impact")).alias("s"))
        return each.groupBy("qid", "block", "id").agg(F.round(F.sum("s"), DIGITS).alias("score")).filter("score > 0")

    def _within(self, asked: DataFrame, wanted: DataFrame) -> DataFrame:
        return self._scores(asked.join(wanted.select("qid", "block"), "qid").join(self.blocks, ["term", "block"]))

    def search(self, queries: DataFrame, k: int = 5, qid: str = "qid", question: str = "question") -> DataFrame:
        """The rows of Bm25Index.search, ties included."""
        return self._searched(queries, k, qid, question)[0]

    def counted(self, queries: DataFrame, k: int = 5, qid: str = "qid", question: str = "question") -> DataFrame:
        """(qid, blocks, scored): blocks that hold a term of the query, and those of them that were scored."""
        _, bounds, first, more = self._searched(queries, k, qid, question)
        read = first.select("qid", "block").unionByName(more.select("qid", "block")).withColumn("read", F.lit(1))
        return bounds.join(read, ["qid", "block"], "left").groupBy("qid").agg(F.count("*").alias("blocks"), F.count("read").alias("scored"))

    def _searched(self, queries: DataFrame, k: int, qid: str, question: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        asked, bounds = self._asked(queries, qid, question), stored(self.bounds(queries, qid, question))
        by_rarity = Window.partitionBy("qid").orderBy("df", "term")
        rare = asked.withColumn("upto", F.sum("df").over(by_rarity)).withColumn("nth", F.row_number().over(by_rarity)).filter((F.col("upto") <= self.RARE * k) | (F.col("nth") == 1))
        partly = self._scores(rare.join(self.blocks.select("term", "block", "postings"), "term"))
        first = stored(top_k(partly, self.FIRST * k).select("qid", "block").distinct())
        found = stored(self._within(asked, first))
        # fewer than k scores set no threshold
        threshold = top_k(found, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        # a bound is rounded once, a score as well
        others = bounds.join(first, ["qid", "block"], "left_anti").join(threshold, "qid", "left")
        more = others.filter(F.col("least").isNull() | (F.col("bound") + 2 * 10.0**-DIGITS >= F.col("least")))
        return top_k(found.unionByName(self._within(asked, more)).select("qid", "id", "score"), k), bounds, first, more
