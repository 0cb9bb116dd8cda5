"""Training-data pipeline: stages over documents, each written as Parquet and reread by the next.

Each stage works on all that the one before kept, and its decisions take effect. All but the last return the columns of their input.

Defined results, the same in all stages: rows are known by their place in the stored table, so null and repeated ids are rows like
others; null texts are empty; columns of any name are carried as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import common
from cellmend.llm.decontaminate import remove_contamination
from cellmend.llm.exact_dedup import exact_dedup
from cellmend.llm.near_copies import near_groups
from cellmend.llm.pack import pack
from cellmend.llm.simhash import simhash_groups
from cellmend.llm.toxicity import THRESHOLD, toxicity

#: Rows of a drop list that may be broadcast: some 10 MB. Longer lists are joined by a shuffle.
BROADCAST_ROWS = 200_000


def without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows (with a row key) whose key is not among dropped."""
    listed = common.save(dropped.select(*common.ROW_KEY), "dropped")
    side = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
    return rows.join(side, common.ROW_KEY, "left_anti").select(*map(common.column, columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the threshold. Texts without words score as clean ones."""
    scored = toxicity(docs, common.table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts: the largest id, of rows that share it any one. Null and empty texts are equal."""
    rows = common.with_row_key(docs)
    return without(rows, exact_dedup(rows, one_by=common.ROW_KEY).where(~F.col("kept")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: the smallest id, of rows that share it any one."""
    rows = common.with_row_key(docs)
    return without(rows, simhash_groups(rows, one_by=common.ROW_KEY).where(~F.col("kept")), docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of what drop_near_copies keeps, one row of each component of texts with a five-word similarity of 0.8 or more, chosen likewise."""
    rows = common.with_row_key(common.save(drop_near_copies(spark, docs, sf_dir), "near"))
    return without(rows, near_groups(rows, common.ROW_KEY).where(~F.col("kept")), docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words in benchmark windows go; from the others such spans are cut."""
    return remove_contamination(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document; an empty one is its end mark."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_similar),
    ("decontaminate", drop_benchmark),
    ("pack", pack_sequences),
]
#: SQL can express neither a trained tagger nor a tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, f"stage-{name}")
    return docs
