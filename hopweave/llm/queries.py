"""The queries of this folder and the SQL that checks them, by name."""

from __future__ import annotations

from hopweave.llm import byte_bpe, decontaminate, fill_middle, language_id, lm_score, mixing, near_dup, quality_model, quality_rules, resampling, secrets, sharding, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_language_id": language_id.op2_language_id,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": quality_model.op9_quality_classifier,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_mixing": mixing.op11_mixing,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_resampling": resampling.op13_resampling,
    "rule_ablation": quality_rules.rule_ablation,
    "shard_ledger": sharding.shard_ledger,
}

ORACLE_SQL = {
    "op5_sharding": sharding.OP5_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op11_mixing": mixing.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_resampling": resampling.OP13_SQL,
    "rule_ablation": quality_rules.ABLATION_SQL,
}
