"""The registered queries of this package and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mimicry.llm import (
    divergence,
    jaccard,
    langid,
    mixing,
    neardup,
    packing,
    perplexity,
    quality,
    secrets,
    suffixes,
    toxicity,
    trie,
    warc,
)



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        packing.op1_best_fit_packing,
        suffixes.op2_suffix_dedup,
        quality.op3_quality_rules,
        perplexity.op4_quality_perplexity,
        toxicity.op5_toxicity,
        neardup.op6_embedding_near_dedup,
        langid.op7_language_id,
        jaccard.op8_ngram_jaccard,
        secrets.op9_secret_scan,
        mixing.op10_source_mix,
        trie.op11_conversation_trie,
        warc.op12_warc_salvage,
        divergence.op13_source_divergence,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op10_source_mix": mixing.OP10_SQL,
    "op11_conversation_trie": trie.OP11_SQL,
    "op12_warc_salvage": warc.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
