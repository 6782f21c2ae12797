"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language_id as _language_id
from quern.llm import line_dedup as _line_dedup
from quern.llm import mixing as _mixing
from quern.llm import ngram_join as _ngram_join
from quern.llm import packing as _packing
from quern.llm.common import Scratch, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on: not those without a letter, nor those whose best language has less than half of all.

    A null lang becomes the predicted one; any other stays. Where no language could be learned (no document has text with a letter,
    a lang and an id), all documents with a letter go on as they are. Null and empty texts have no letter. Rows are judged one by one, so repeated rows,
    null ids and further columns pass; an empty table stays empty.
    """
    language = _language_id.fit(docs)
    if not language.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), language(F.col("text")).alias("said"))
    kept = judged.filter((F.col("said.lang_pred") != "und") & (F.col("said.score") >= 0.5))
    return kept.select(*[(F.coalesce("doc.lang", "said.lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`")) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines, those of 50 words or more from 3 sites on, leave the texts but for their first place; n_chars follows the text.

    No document goes, though its text may become empty. Null texts stay null, repeated rows are cleaned alike, a null source is a site of its own; an
    empty table stays empty.
    """
    cleaned = _line_dedup.line_dedup(docs, long_words=50)
    return cleaned.select(*[(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that shingles of five words link at 0.8: its smallest doc_id.

    Of rows with that id the one of smallest text hash stays, of rows repeated whole one; a null id is after all others. Documents without
    words (null and empty texts too) are in no group and all stay, repeated rows of them too. An empty table stays empty.
    """
    return _ngram_join.keep_one(docs, n_words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 3 times.

    A null source is a source of its own; null and empty texts have size 0; rows repeated whole are drawn one by one. An empty table stays empty.
    """
    return _mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096 at most: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end token. Rows that the mix repeats are pieces of their own. Empty table: empty result.
    """
    return _packing.best_fit_pack(_packing.token_pieces(docs))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage has left in the shared folder goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        scratch = Scratch(spark)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
            scratch.clear(keep_last=True)
    return docs


#: Fitted models, draws and packing have no SQL form; the stages and run() are tested against brute force instead (tests/llm/test_pipeline.py).
ORACLE_SQL = None
