"""The corpus queries: one ``opN_<name>`` per operator with its production parameters, and their SQL."""

from __future__ import annotations

from tidemark.llm import align, brown, kmtree, licenses, maxscore, minhash, mixing, packing, quality, secrets, sharding, simhash, warc

def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_minhash_tensored": minhash.op1,
    "op2_warc_chain": warc.op2,
    "op3_kmeans_tree": kmtree.op3,
    "op4_vector_packing": packing.op4,
    "op5_license_rules": licenses.op5,
    "op6_secret_worklist": secrets.op6,
    "op7_jump_shards": sharding.op7,
    "op8_quality_ledger": quality.op8,
    "op9_raked_mixture": mixing.op9,
    "op10_brown_classes": brown.op10,
    "op11_pair_alignment": align.op11,
    "op12_simhash_anchors": simhash.op12,
    "op13_pair_maxscore": maxscore.op13,
}

ORACLE: dict[str, str] = {
    "op2_warc_chain": warc.ORACLE,
    "op8_quality_ledger": quality.ORACLE,
    "op13_pair_maxscore": maxscore.ORACLE,
}
