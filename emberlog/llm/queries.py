"""The queries of the numbered operators and of the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    bench_prefix, bpe_count, cube_mix, golay_simhash, lang_bayes, license_votes, line_winnow, prefix_trie, quality_fences, secret_ledger, token_bridge, toxic_kernel,
    voronoi_topk,
)
from emberlog.llm.oracle import ORACLE_TEXTS
from emberlog.llm.rows import KEY, read
from emberlog.session import scratch_dir, use_utc

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(use_utc(spark), sf_dir)

    LLM_QUERIES[run.__name__] = pinned
    if run.__name__ in ORACLE_TEXTS:
        LLM_ORACLES[run.__name__] = ORACLE_TEXTS[run.__name__]
    return run


@query
def op10_benchmark_decontamination(spark, sf_dir):
    """Words of each document that lie in windows of 13 benchmark words."""
    return bench_prefix.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op6_token_counts(spark, sf_dir):
    """Bytes and tokens of every text."""
    return bpe_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    return golay_simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op8_quality_rules(spark, sf_dir):
    """Measures of every document and whether it stays within the bounds of its language and source."""
    return quality_fences.rate(read(spark, sf_dir, "documents")).drop("n_lines", "n_echo_words")


@query
def op2_source_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return cube_mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_line_dedup(spark, sf_dir):
    """Runs of words of every document that occur earlier in the corpus."""
    return line_winnow.find_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "spans")


@query
def op3_license_scan(spark, sf_dir):
    """Licence phrases and notices in every document."""
    return license_votes.find_licenses(read(spark, sf_dir, "documents")).drop(*KEY, "spans")


@query
def op1_secret_scan(spark, sf_dir):
    """Secrets in every document, through a ledger that starts empty."""
    found = secret_ledger.scan_incremental(read(spark, sf_dir, "documents"), scratch_dir(spark, "ledger"))
    base = F.filter("found", lambda s: s["kind"].isin(*secret_ledger.BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select("doc_id", *[count(k) for k in secret_ledger.BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@query
def op5_language_id(spark, sf_dir):
    """Predicted language of every document, learned from those not held out."""
    docs = read(spark, sf_dir, "documents")
    return lang_bayes.identify(docs, docs.filter(~lang_bayes.held_out())).select("doc_id", lang_bayes.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels of those not held out."""
    docs, held_out = read(spark, sf_dir, "documents"), toxic_kernel.held_out()
    model = toxic_kernel.fit(docs, read(spark, sf_dir, "labels").filter(~held_out))
    return toxic_kernel.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_exact_top_k(spark, sf_dir):
    """The five vectors with the highest inner product with each fiftieth vector."""
    return voronoi_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op12_cross_tokenizer_alignment(spark, sf_dir):
    """Tokens of two tokenizers in every text, where both cut, and how usual their partners are."""
    return token_bridge.bridge(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).drop(*KEY)


@query
def op13_conversation_prefix_trie(spark, sf_dir):
    """All nodes of the trie of rebuilt conversations, with totals of their subtrees."""
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
