"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from strandline.llm import bpe, decontaminate, exact_dedup, extract, lm, near_dedup, pii, secret_scan, sharding, toxicity

QUERIES = {
    "op1_backoff_lm_scores": lm.op1,
    "op2_host_suffix_extraction": extract.op2,
    "op3_exact_dedup_stream": exact_dedup.op3,
    "op4_permutation_sharding": sharding.op4,
    "op5_bpe_round_trip": bpe.op5,
    "op6_latent_decontamination": decontaminate.op6,
    "op7_toxicity_cnn": toxicity.op7,
    "op8_secret_ownership": secret_scan.op8,
    "op9_minhash_near_dedup": near_dedup.op9,
    "op10_pii_checksums": pii.op10,
}

ORACLES = {
    "op3_exact_dedup_stream": exact_dedup.OP3_SQL,
}
