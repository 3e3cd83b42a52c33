"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siftwell.llm import decontaminate, license_scan, near_dedup, ngram_lm, packing, quality, suffix_dedup, token_rollup, url_filter, warc_zip

MODULES = {
    "op1_license_scan": license_scan,
    "op2_packing": packing,
    "op3_warc_zip": warc_zip,
    "op4_lm_scoring": ngram_lm,
    "op5_decontamination": decontaminate,
    "op6_token_counts": token_rollup,
    "op7_suffix_dedup": suffix_dedup,
    "op8_near_dedup": near_dedup,
    "op9_url_filter": url_filter,
    "op10_quality": quality,
}
QUERIES = {name: m.query for name, m in MODULES.items()}
SQL = {name: m.SQL for name, m in MODULES.items() if hasattr(m, "SQL")}
