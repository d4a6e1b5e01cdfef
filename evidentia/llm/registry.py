"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, embeddings, minhash, mixing, negatives, packing, sharding, substring, suffix, toxicity, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_warc_archive": warc.op3_warc_archive,
        "op4_harmonic_packing": packing.op4_harmonic_packing,
        "op5_suffix_array_dedup": suffix.op5_suffix_array_dedup,
        "op6_hypergeometric_sharding": sharding.op6_hypergeometric_sharding,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_url_filter": urls.op8_url_filter,
        "op9_embedding_near_dedup": embeddings.op9_embedding_near_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_weighted_mixing": mixing.op11_weighted_mixing,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": minhash.OP1_SQL,
        "op2_substring_dedup": substring.OP2_SQL,
        "op3_warc_archive": warc.OP3_SQL,
        "op5_suffix_array_dedup": suffix.OP5_SQL,
        "op9_embedding_near_dedup": embeddings.OP9_SQL,
        "op11_weighted_mixing": mixing.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
    }
