"""The numbered operators bound to the given tables, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import (
    common, cross_entropy, filter_audit, harmonic, language, line_crf, mixing, nn_descent, rans, simhash, span_dedup, topk, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


@query("op1_simhash_near_dedup")
def _(spark, sf_dir):
    return simhash.simhash_groups(common.documents(spark, sf_dir))


@query("op5_exact_top_k")
def _(spark, sf_dir):
    return topk.top_k(common.table(spark, sf_dir, "embeddings"))


ORACLES["op5_exact_top_k"] = topk.oracle()


@query("op6_language_id")
def _(spark, sf_dir):
    return language.identify(common.documents(spark, sf_dir))


@query("op7_source_mixing")
def _(spark, sf_dir):
    return mixing.mix(common.documents(spark, sf_dir))


@query("op10_harmonic_packing")
def _(spark, sf_dir):
    return harmonic.pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_suffix_array_dedup")
def _(spark, sf_dir):
    return span_dedup.repeated_passages(common.documents(spark, sf_dir))


@query("op2_line_quality")
def _(spark, sf_dir):
    return line_crf.score_documents(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


@query("op4_embedding_near_dedup")
def _(spark, sf_dir):
    return nn_descent.near_vectors(common.table(spark, sf_dir, "embeddings"))


ORACLES["op4_embedding_near_dedup"] = nn_descent.oracle()


@query("op8_token_files")
def _(spark, sf_dir):
    """Files below the shared folder, read back; they stay there for the folder's lifetime rule."""
    path = common.workspace(spark, "tokens")
    rans.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return rans.read_documents(spark, path)


@query("op9_cross_entropy_difference")
def _(spark, sf_dir):
    """Wanted: documents labelled of good quality and not toxic."""
    wanted = common.table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return cross_entropy.cross_entropy_difference(common.documents(spark, sf_dir), wanted)


@query("op11_filter_interactions")
def _(spark, sf_dir):
    return filter_audit.filter_interactions(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interactions"] = filter_audit.oracle()


@query("op12_incremental_whitening")
def _(spark, sf_dir):
    return whitening.digest(whitening.whiten(common.table(spark, sf_dir, "embeddings")))


@query("op13_warc_salvage")
def _(spark, sf_dir):
    """Archives below the shared folder, read back; they stay there for the folder's lifetime rule."""
    path = common.workspace(spark, "warc")
    common.small_batches(spark)
    warc.write_archives(common.table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read_archives(spark, path, with_payload=False))


ORACLES["op13_warc_salvage"] = warc.oracle()
