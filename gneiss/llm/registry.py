"""The contract's queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from gneiss.llm import ann, decontaminate, html_extract, packing, pseudo_likelihood, quality, sharding, simhash, substring_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_decontamination": decontaminate.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_best_fit_packing": packing.query,
    "op5_warc": warc.query,
    "op6_sharding": sharding.query,
    "op7_pseudo_likelihood": pseudo_likelihood.query,
    "op8_nearest": ann.query,
    "op9_quality": quality.query,
    "op10_html_text": html_extract.query,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op5_warc": warc.SQL,
}
