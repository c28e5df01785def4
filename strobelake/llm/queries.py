"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strobelake.llm import decontaminate, embedding_dedup, importance_resampling, pii, quality, sentencepiece_codec, simhash_dedup, spelling_variants, token_store, toxicity, url_filter, vector_search, warc_writer


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.query,
        "op2_token_store": token_store.query,
        "op3_pii": pii.query,
        "op4_sentencepiece": sentencepiece_codec.query,
        "op5_decontaminate": decontaminate.query,
        "op6_warc_writer": warc_writer.query,
        "op7_toxicity": toxicity.query,
        "op8_url_filter": url_filter.query,
        "op9_quality": quality.query,
        "op10_simhash_dedup": simhash_dedup.query,
        "op11_spelling_variants": spelling_variants.query,
        "op12_vector_search": vector_search.query,
        "op13_importance_resampling": importance_resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": embedding_dedup.SQL, "op6_warc_writer": warc_writer.SQL, "op8_url_filter": url_filter.SQL, "op12_vector_search": vector_search.SQL}
