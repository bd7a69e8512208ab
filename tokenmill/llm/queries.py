"""Registered queries of this subpackage: name -> (query, SQL twin or None)."""

from __future__ import annotations

from tokenmill.llm import decontaminate, jaccard, language, minhash, quality, runs, secrets, sharding, subwords, token_counts, urls, warc, whitening

REGISTERED = {
    "op1_secret_scans": (secrets.op1, secrets.OP1_SQL),
    "op2_sentencepiece": (subwords.op2, None),
    "op3_token_counts": (token_counts.op3, token_counts.OP3_SQL),
    "op4_benchmark_decontamination": (decontaminate.op4, decontaminate.OP4_SQL),
    "op5_language_id": (language.op5, None),
    "op6_quality_rules": (quality.op6, quality.OP6_SQL),
    "op7_warc": (warc.op7, warc.OP7_SQL),
    "op8_sharding": (sharding.op8, None),
    "op9_ngram_jaccard_join": (jaccard.op9, None),
    "op10_url_filters": (urls.op10, None),
    "op11_minhash_near_dedup": (minhash.op11, None),
    "op12_embedding_whitening": (whitening.op12, None),
    "op13_periodic_runs": (runs.op13, None),
}
