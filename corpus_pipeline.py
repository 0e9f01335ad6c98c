"""The corpus pipeline: documents in, packed training windows out.

Each stage takes any table with the columns of ``documents``, in any order
and with others beside them, which it returns as they are; the last returns
its own. Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specweave.llm.mixing import mixed
from specweave.llm.near_dup import deduplicate
from specweave.llm.packing import pack
from specweave.llm.toxicity import drop_toxic
from specweave.runtime import materialize, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 0.3.

    Null and empty texts are scored as a window without words; repeated rows
    are scored alike. Labels of null documents and null labels teach nothing;
    without labels of both kinds all documents stay.
    """
    return drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): the smallest id.

    Texts without words are no duplicates and stay, as do all rows with a
    null id. Of rows that repeat an id one stays.
    """
    ship(spark)
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, whole.

    A text comes once for each pass that takes half of its words or more, one
    without words never. A null source is one of its own, after the others;
    equal rows share what is taken of them.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin and an offset for each piece of a document.

    Long texts are cut into pieces; equal texts never share a bin. Rows with
    null ids or sources and repeated rows are packed like others; a text
    without words has a row without a bin.
    """
    ship(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The stages score texts by a trained network, so SQL can't give their rows; tests hold them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
