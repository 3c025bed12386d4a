"""One query per operator over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeframe.llm import (bpe, chat, exact, langid, manifest, mixing, phrases, pii, quality,
                           shards, simhash, token_counts, token_files)

Build = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), pattern(),
                          with_ids=with_ids)


def count(docs: DataFrame) -> DataFrame:
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), pattern(),
                                     special=["<|endoftext|>"])


def token_ids(docs: DataFrame) -> DataFrame:
    return token_files.op10(docs, tokenizer("word_bpe_49k.json"))


OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "op1_simhash": simhash.op1,
    "op2_shards": shards.op2,
    "op3_quality": quality.op3,
    "op4_pii": pii.span_digests,
    "op5_exact_dedup": exact.op5,
    "op6_bpe": encode,
    "op7_language": langid.op7,
    "op8_token_counts": count,
    "op9_mixing": mixing.op9,
    "op10_token_files": token_ids,
    "op12_phrases": phrases.op12,
    "op13_manifest": manifest.op13,
}
CONVERSATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"op11_chat": chat.op11}
SQL = {"op5_exact_dedup": exact.SQL, "op9_mixing": mixing.SQL, "op11_chat": chat.SQL,
       "op12_phrases": phrases.SQL, "op13_manifest": manifest.SQL}


def _over(table: str, of: Callable[[DataFrame], DataFrame]) -> Build:
    return lambda spark, sf_dir: of(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Build]:
    return {name: _over("documents", of) for name, of in OPERATORS.items()} | {
        name: _over("conversations", of) for name, of in CONVERSATIONS.items()}
