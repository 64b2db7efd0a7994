"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, divergence, jaccard, lm, mixing, neardup, packing, repeats, sharding, toxicity, trie, urls, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_lm_scoring": lm.op3_lm_scoring,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_pivot_neardup": neardup.op5_pivot_neardup,
        "op6_histogram_sharding": sharding.op6_histogram_sharding,
        "op7_suffix_dedup": repeats.op7_suffix_dedup,
        "op8_collision_counting": ann.op8_collision_counting,
        "op9_curriculum_mix": mixing.op9_curriculum_mix,
        "op10_warc_index_first": warc.op10_warc_index_first,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_url_cascade": urls.op12_url_cascade,
        "op13_prefix_trie": trie.op13_prefix_trie,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_curriculum_mix": mixing.OP9_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_url_cascade": urls.OP12_SQL, "op13_prefix_trie": trie.OP13_SQL}
