"""Queries of this subpackage, and SQL for those that SQL can express."""

import corpus_pipeline
from chronolith.llm import edit_fingerprint, embedding_dedup, fill_middle, filter_audit, ngram_join, packing, quality, sentencepiece_bpe, suffix_dedup, token_counts, token_store, toxicity, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_importance_resampling": quality.op5_importance_resampling,
        "op6_edit_fingerprints": edit_fingerprint.op6_edit_fingerprints,
        "near_fingerprints": edit_fingerprint.near_fingerprints,
        "op7_warc": warc.op7_warc,
        "op8_sentencepiece": sentencepiece_bpe.op8_sentencepiece,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
        "op13_token_orc": token_store.op13_token_orc,
    }


def oracle_sql():
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op2_embedding_dedup": embedding_dedup.ORACLE, "op7_warc": warc.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE}
