"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import shipped
from . import bpe, chunking, embedding, language, media, minhash, oracles, packing, suffix, tokens, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_suffix_dedup": suffix.op1_suffix_dedup,
        "op2_content_chunks": chunking.op2_content_chunks,
        "op3_warc": warc.op3_warc,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_multi_index": embedding.op5_multi_index,
        "op6_minhash": minhash.op6_minhash,
        "op7_wavelet_tokens": tokens.op7_wavelet_tokens,
        "op8_language_id": language.op8_language_id,
        "page_languages": language.page_languages,
        "op9_avi_mjpeg": media.op9_avi_mjpeg,
        "op10_length_buckets": packing.op10_length_buckets,
        "packed_batches": packing.packed_batches,
    }
    return {name: shipped(query) for name, query in found.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
