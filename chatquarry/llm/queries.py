"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import op1_token_store, op2_sharding, op3_language, op4_jaccard, op5_language_model, op6_exact_dedup, op7_packing, op8_bpe, op9_fingerprint, op10_secrets, op11_fim, op12_decontamination, op13_alignment


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store.query,
        "op2_hash_tree_sharding": op2_sharding.query,
        "op3_compression_language": op3_language.query,
        "op4_ngram_jaccard": op4_jaccard.query,
        "op5_deleted_interpolation": op5_language_model.query,
        "op6_exact_dedup": op6_exact_dedup.query,
        "op7_best_fit_packing": op7_packing.query,
        "op8_bpe": op8_bpe.query,
        "op9_scaled_sketch": op9_fingerprint.query,
        "op10_secret_scan": op10_secrets.query,
        "op11_distinct_text_fim": op11_fim.query,
        "op12_benchmark_decontamination": op12_decontamination.query,
        "op13_group_dictionary_alignment": op13_alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard": op4_jaccard.ORACLE,
        "op6_exact_dedup": op6_exact_dedup.ORACLE,
        "op11_distinct_text_fim": op11_fim.ORACLE,
        "op12_benchmark_decontamination": op12_decontamination.ORACLE,
    }
