"""The named queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewise.llm import chat, exact_dedup, lexical_search, mixing
from casewise.llm.alignment import aligned
from casewise.llm.common import table
from casewise.llm.decontaminate import contaminated
from casewise.llm.embedding_dedup import near_duplicates
from casewise.llm.jaccard_join import jaccard_components
from casewise.llm.language import language_of
from casewise.llm.paragraph_dedup import repeated_passages
from casewise.llm.quality import quality_scores
from casewise.llm.sharding import shard
from casewise.llm.token_counts import token_counts


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


def op3_shard(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_of(table(spark, folder, "documents"))


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_digest(chat.with_trial(table(spark, folder, "conversations")))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned(table(spark, folder, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_shard": op3_shard,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_chat": op10_chat,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
