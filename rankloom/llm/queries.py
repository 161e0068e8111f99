"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from rankloom.llm import bpe, decontam, divergence, exact_dedup, fim, html_extract, langid, license_scan, packing, secret_scan, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_packing": packing.op4_token_packing,
        "op5_warc": warc.op5_warc,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_language_id": langid.op7_language_id,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op10_simhash": simhash.op10_simhash,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_license_scan": license_scan.OP2_SQL,
        "op5_warc": warc.OP5_SQL,
        "op11_fill_in_middle": fim.OP11_SQL,
        "op12_secret_scan": secret_scan.OP12_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
