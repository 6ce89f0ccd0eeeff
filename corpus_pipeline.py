"""A corpus from raw documents: known languages, one of each near-duplicate, no benchmark text, mixed, as token files.

Each stage works on all that the one before kept, which is written and read again between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import decontaminate, langid, mixing, simhash, tokenfiles
from tidefold.llm.common import crc32_mod, folders, release, shared_dir, table

_left: dict[tuple[str, int], list[str]] = {}


def _stage(f: Callable) -> Callable:
    """A stage that first deletes what the one before it left in the shared folder beside its result.

    So a stage's result must be written and read again before the next stage is called, and one pipeline runs in a
    thread at a time. What other operators make meanwhile, in this session or thread, stays. What the last stage makes, the token
    files, is the corpus and stays, too.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = (spark.sparkContext.applicationId, get_ident())
        release(spark, _left.pop(own, []))
        with folders() as made:
            out = f(spark, docs, sf_dir)
        if f.__name__ != "token_files":
            _left[own] = made
        return out

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject: it learns from the rows that aren't held out.

    Texts that are null, empty or without a letter have no language and go, and so do all where no row has a language to
    learn. Long texts are looked at whole, repeated rows fare alike, an empty table stays empty, and further columns stay
    whatever their names.
    """
    return langid.keep_identified(docs, langid.fit(docs, crc32_mod("doc_id", 3) != 1))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Null and empty texts are like each other, so one of all of them stays. Of rows that tie, repeated ones included, one stays.
    Long texts are fingerprinted whole; an empty table stays empty, and further columns stay whatever their names.
    """
    return simhash.keep_one(docs)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts and those without words hold none and stay, and so does all where the benchmark is empty. Long
    texts are scanned whole, repeated rows fare alike, an empty table stays empty, further columns stay whatever their names.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, twice at most.

    Null sources are one source, the last. Texts without words, null ones included, have no size: whether they are drawn is
    decided by their place in the mix. Rows of one id are told apart by their text; an empty table stays empty, and
    further columns stay whatever their names.
    """
    return mixing.draw(docs)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32, in ascending doc_id.

    Null and empty texts are one end id each; repeated rows are documents each, null ids come first; an empty table
    gives no rows, and further columns are not read.
    """
    return tokenfiles.encode_and_read(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("token_files", token_files)]

#: Language models, fingerprints' components and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
