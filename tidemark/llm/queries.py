"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import (bpe, collocations, dedup, language, licenses, mixing, prefixes, privacy, sharding, simhash,
                          similar, topk, toxicity)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_licenses": licenses.op2_licenses,
    "op3_mixing": mixing.op3_mixing,
    "op4_language": language.op4_language,
    "op5_exact_dedup": dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_privacy": privacy.op7_privacy,
    "op8_bpe": bpe.op8_bpe,
    "op9_topk": topk.op9_topk,
    "op10_simhash": simhash.op10_simhash,
    "op11_prefixes": prefixes.op11_prefixes,
    "op12_similar": similar.op12_similar,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_sharding": sharding.sql(),
    "op3_mixing": mixing.SQL,
    "op5_exact_dedup": dedup.SQL,
    "op9_topk": topk.SQL,
    "op11_prefixes": prefixes.SQL,
    "op12_similar": similar.SQL,
    "op13_collocations": collocations.SQL,
}
