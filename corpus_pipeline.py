"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents.  All but the last return the columns of
documents, whatever others there are: a stage carries a row's columns in one
struct, so names of its own never meet them.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textsluice.llm import decontam, packing, quality, simhash, substrings
from textsluice.llm.common import kept
from textsluice.llm.queries import tokenizer
from textsluice.sources.tables import table


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Every row is scored by its text, a null text as an empty one; rows with null
    or repeated ids are judged each.  Labels without a value or a document teach
    nothing; without any, all scores are 0.5 and all documents stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text", _row(docs)), model).where("predicted = 1").select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that with the smallest id.

    A null text is empty, and empty texts are copies of each other; of rows that
    repeat an id one stays; rows without an id, which no group can name, stay.
    """
    return simhash.one_of_each(docs.select("doc_id", "text", _row(docs))).select("row.*")


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds.

    Changed texts have a new ``n_chars``, where that is a column; documents of
    which nothing is left go.  Null and empty texts and rows without an id stay
    as they are; rows that repeat an id and text are cut alike.
    """
    edited = ["text", *(c for c in docs.columns if c == "n_chars")]
    cut = substrings.deduplicated(docs.select("doc_id", *edited, _row(docs)))
    row = F.col("row")
    for name in edited:
        row = row.withField(name, F.col(name))
    return cut.select(row.alias("row")).select("row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none; rows without an id stay; of rows that repeat
    an id all go if one holds a passage.
    """
    return decontam.clean(docs.select("doc_id", "text", _row(docs)), table(spark, sf_dir, "benchmark")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences; a null or empty text is its end
    token, rows with null or repeated ids are packed each."""
    return packing.packed(docs, tokenizer())


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", near_copies_stage), ("substring dedup", passages_stage),
          ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)]

#: No SQL expresses the classifier or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
