"""The queries of the corpus operators, with production parameters on their whole tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, fingerprint, language_id, line_dedup, mixing, ngram_join, packing, periodic, sharding, spelling, token_files, topk, url_filter
from quern.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_back = language_id.held_out("doc_id")
    language = language_id.fit(docs.filter(~kept_back))
    found = docs.select("doc_id", kept_back.alias("held_out"), language(F.col("text")).alias("said"))
    return found.select("doc_id", "held_out", "said.lang_pred", "said.score")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), n_words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op7_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.filter("vec_id % 100 = 0"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.periodic_runs(edited, least=6, times=4))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), min_length=6, slip=199)
    return spelling.spelling_variants(counts, min_count=5, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs), dict(docs.dtypes)["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_mixing_to_target_weights": op7_mixing_to_target_weights,
    "op8_sharding": op8_sharding,
    "op9_exact_topk_search": op9_exact_topk_search,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL.format(min_sites=10),
    "op6_ngram_jaccard_join": ngram_join.SQL.format(n=4, percent=85),
    "op8_sharding": sharding.SQL,
    "op9_exact_topk_search": topk.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_spelling_variants": spelling.SQL,
}
