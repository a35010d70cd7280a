"""Operators for building training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import ann, cells, classifier, middle, negatives, ordermin, packing, phrases, pieces, rules, suffix, tokens, warc


def queries() -> dict:
    return {
        "op1_permutation_ann": ann.op1_permutation_ann,
        "op2_gumbel_segmentations": pieces.op2_gumbel_segmentations,
        "gumbel_round_trip": pieces.gumbel_round_trip,
        "op3_quality_rules": rules.op3_quality_rules,
        "quality_rule_ablations": rules.quality_rule_ablations,
        "op4_quality_classifier": classifier.op4_quality_classifier,
        "op5_packing": packing.op5_packing,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_suffix_dedup": suffix.op7_suffix_dedup,
        "op8_warc_salvage": warc.op8_warc_salvage,
        "warc_salvage_gaps": warc.warc_salvage_gaps,
        "op9_order_minhash": ordermin.op9_order_minhash,
        "op10_repeated_passages": phrases.op10_repeated_passages,
        "op11_fill_in_middle": middle.op11_fill_in_middle,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_metric_range_join": cells.op13_metric_range_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": rules.ORACLE, "quality_rule_ablations": rules.ABLATIONS, "op8_warc_salvage": warc.ORACLE, "warc_salvage_gaps": warc.SALVAGED, "op10_repeated_passages": phrases.ORACLE, "op11_fill_in_middle": middle.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_metric_range_join": cells.ORACLE}
