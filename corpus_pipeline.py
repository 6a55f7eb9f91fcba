"""The corpus pipeline: five stages, each over all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All stages but the last return the columns of
documents.

Defined cases: rows with a null or empty text, or without a letter, go in the first stage; a null id or
source is kept like others, as the largest. Very long texts are read whole. Repeated rows are near
copies, of which one stays: of a group that with the smallest id, of equal ids that with the smallest
hash. An empty table gives an empty result. Other columns of documents are carried along, whatever
their names; where the mix would add one of the same name, `_` is appended to its name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, language_id, line_templates, mixing, simhash
from tidewright.llm.common import Workspace, crc_bucket, documents

#: Texts whose cosine with every language is lower are no language.
MIN_COSINE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or like no language, go; the others get the language found as their lang.

    Prototypes come from the labels of documents, without its held-out rows.
    """
    known = docs.filter(crc_bucket(F.col("doc_id"), 4) != 2)
    profiles = language_id.train(known, "text", "lang")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = language_id.identify(docs, "text", profiles, {"row": whole})
    found = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_COSINE))
    return found.select(*[F.col("lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all texts but the first; rows left without a word go."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = line_templates.deduplicated(docs, {"row": whole})
    found = found.filter((F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    edited = F.col("n_dropped") > 0
    new = {"text": F.when(edited, F.col("kept")), "n_chars": F.when(edited, F.char_length("kept").cast("long"))}
    return found.select(*[(F.coalesce(new[c], F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.representatives(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents' columns, the epoch and the words taken, a row for each time one is taken."""
    return mixing.mixed(docs)


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """What earlier stages left in the shared folder is freed first: their results are written by then."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with Workspace.stage(docs):
            return function(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", _stage(language)),
    ("line dedup", _stage(lines)),
    ("SimHash near-dedup", _stage(near_duplicates)),
    ("benchmark decontamination", _stage(benchmarks)),
    ("mixing", _stage(mix)),
]

#: Hash-based vectors, XXH64 and template trees have no SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        ws.close(docs)
    return docs
