"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.balltree import ORACLE as TOP_ORACLE
from recoflow.llm.balltree import top_k
from recoflow.llm.bpe import round_trip
from recoflow.llm.chat import ORACLE as CHAT_ORACLE
from recoflow.llm.chat import format_chats
from recoflow.llm.codes import ORACLE as CODES_ORACLE
from recoflow.llm.codes import vector_codes
from recoflow.llm.common import table
from recoflow.llm.idfiles import id_files
from recoflow.llm.linededup import ORACLE as LINES_ORACLE
from recoflow.llm.linededup import op9_line_dedup
from recoflow.llm.neardup import near_duplicates
from recoflow.llm.packing import pack_documents
from recoflow.llm.quality import classify
from recoflow.llm.repeats import ORACLE as REPEATS_ORACLE
from recoflow.llm.repeats import kept_digest, without_repeats
from recoflow.llm.tokencount import count_tokens
from recoflow.llm.tokenizers_io import tokenizer_path
from recoflow.llm.trie import ORACLE as TRIE_ORACLE
from recoflow.llm.trie import conversation_trie
from recoflow.llm.winnow import edited_fingerprints


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), sample=20_000)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("row")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(without_repeats(table(spark, sf_dir, "documents"), length=100))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k_search": op1_top_k_search,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_id_files": op8_id_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_top_k_search": TOP_ORACLE,
    "op5_chat_formatting": CHAT_ORACLE,
    "op9_line_dedup": LINES_ORACLE,
    "op11_prefix_trie": TRIE_ORACLE,
    "op12_suffix_dedup": REPEATS_ORACLE,
    "op13_vector_codes": CODES_ORACLE,
}
