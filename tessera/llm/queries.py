"""The queries and oracle SQL of this package for the driver contract."""

from __future__ import annotations

from tessera.llm import embedding_dedup, hilbert, minhash, mixing, quality
from tessera.llm.embedding_dedup import op7_spherical_cells
from tessera.llm.hilbert import op5_hilbert_shards
from tessera.llm.language import op8_ftrl_language
from tessera.llm.minhash import op4_coordinate_join
from tessera.llm.mixing import op3_temperature_mix
from tessera.llm.packing import op10_best_fit
from tessera.llm.quality import op1_rule_ledger
from tessera.llm.secrets import op6_guess_cost_secrets
from tessera.llm.token_output import op2_pfor_tokens
from tessera.llm.toxicity import op9_ordinal_toxicity

QUERIES = {
    "op1_rule_ledger": op1_rule_ledger,
    "op2_pfor_tokens": op2_pfor_tokens,
    "op3_temperature_mix": op3_temperature_mix,
    "op4_coordinate_join": op4_coordinate_join,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_guess_cost_secrets": op6_guess_cost_secrets,
    "op7_spherical_cells": op7_spherical_cells,
    "op8_ftrl_language": op8_ftrl_language,
    "op9_ordinal_toxicity": op9_ordinal_toxicity,
    "op10_best_fit": op10_best_fit,
    "rule_ablations": quality.rule_ablations,
}
ORACLES: dict[str, str] = {
    "op1_rule_ledger": quality.ORACLE,
    "rule_ablations": quality.ABLATIONS_ORACLE,
    "op3_temperature_mix": mixing.ORACLE,
    "op4_coordinate_join": minhash.ORACLE,
    "op5_hilbert_shards": hilbert.ORACLE,
    "op7_spherical_cells": embedding_dedup.ORACLE,
}
