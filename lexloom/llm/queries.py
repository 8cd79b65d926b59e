"""The queries of the training-data operators, with production parameters over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, hard_negatives, minhash, mixing, packing, pii, quality, secrets, suffix_dedup, token_files, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality": quality.op2_quality,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_mixing": mixing.op4_mixing,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_pii": pii.op6_pii,
        "op7_token_files": token_files.op7_token_files,
        "op8_secrets": secrets.op8_secrets,
        "op9_minhash": minhash.op9_minhash,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op6_pii": pii.OP6_SQL, "op8_secrets": secrets.OP8_SQL, "op9_minhash": minhash.OP9_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_suffix_dedup": suffix_dedup.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
