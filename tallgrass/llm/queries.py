"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from tallgrass.llm import decontaminate, licenses, line_dedup, merkle, mixing, quality, ranked_search, secret_scan, simhash, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_token_files": token_files.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

#: The others need the tokenizer, XXH64, match positions or an iterative estimate; their tests compare brute force.
ORACLES = {
    "op1_license_scan": licenses.SQL,
    "op2_url_filter": url_filter.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
