"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_mih, centroids, chat_format, exact_dedup, language_id, license_scan, minhash_dedup, mixing, packing, pii, prefix_trie, quality_crf, secret_scan


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [
        packing.op1_best_fit_packing,
        secret_scan.op2_secret_scan,
        mixing.op3_mixing_weights,
        pii.op4_pii,
        language_id.op5_language_id,
        license_scan.op6_license_scan,
        minhash_dedup.op7_minhash_near_dedup,
        exact_dedup.op8_exact_dedup,
        quality_crf.op9_quality_classifier,
        ann_mih.op10_ann_mih,
        chat_format.op11_chat_format,
        prefix_trie.op12_prefix_trie,
        centroids.op13_centroids,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing_weights": mixing.OP3_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_chat_format": chat_format.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
    }
