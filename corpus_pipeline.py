"""From raw documents to packed training sequences: quality rules, line dedup, SimHash, suffix-array dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame: the documents that stay,
in their own columns, and at last the packed pieces. A stage's docs must be a table: the same rows in the same partitions
whenever it is read, as `run` and every driver of STAGES see to by writing each result as Parquet and reading it again.

Defined results, for every stage: docs' other columns may have any names and pass through as they are; an empty table gives
no rows; a null lang or source is a value of its own. What a stage does with null, empty and very long texts, ties and
repeated rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, op2_quality, op3_packing, op7_simhash, op8_suffix, op10_lines
from quern.session import configure

#: Bytes of a passage that goes where it is repeated: passages of over 50 words mostly have 320 or more.
PASSAGE = 256


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, so that repeated ids and rows stay apart, and that column's name."""
    name = common.unused("rid", *docs.columns)
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in the order of columns, n_chars (if there is one) following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep.

    Null and empty texts have no words and go; texts are read whole, however long; repeated rows are judged alike.
    """
    configure(spark)
    rows, rid = _numbered(docs)
    figures = op2_quality.base(rows.select("doc_id", "text", "lang", "source", F.col(rid).alias("rid")), "rid", "lang", "source")
    kept = op2_quality.verdicts(figures).where("kept").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has nearly the same.

    A null text stays null; lines without a word stay; of repeated rows the first in the table keeps its lines.
    """
    configure(spark)
    name = common.unused("kept", *docs.columns)
    found = op10_lines.dedup(docs, name=name)
    return _with_text(found.withColumn("text", op10_lines.remaining(F.split("text", "\n"), F.col(name))), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first in the table, of each group of near duplicates.

    Texts without a word, null ones included, have fingerprint zero and are one group; repeated rows are another.
    """
    configure(spark)
    rows, rid = _numbered(docs)
    found = op7_simhash.near_duplicates(rows.select(F.col(rid).alias("doc_id"), "text"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what is covered by strings of PASSAGE bytes that also start elsewhere (whole characters).

    All occurrences go, the first too, so repeated rows become empty texts; a null text becomes the empty one.
    """
    configure(spark)
    rest = [c for c in docs.columns if c != "text"]
    found = op8_suffix.dedup(docs, *rest, length=PASSAGE, characters=True)
    return _with_text(found.withColumn("text", F.col("kept").cast("string")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens.

    A null or empty text is one piece of a single end token; a longer one is cut; repeated rows are packed each.
    """
    configure(spark)
    return op3_packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing),
]

#: The stages tokenise and hash in ways that SQL can't; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
