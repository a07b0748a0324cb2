"""The dealt operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from rastercat.llm import decontaminate, exact_dedup, licences, merkle, minhash, mixing, pii, quality, repeats, token_files, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_repeats": repeats.op3_repeats,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_minhash": minhash.op6_minhash,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_mix": mixing.op8_mix,
        "op9_licences": licences.op9_licences,
        "op10_quality": quality.op10_quality,
        "op11_merkle": merkle.op11_merkle,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeats": repeats.ORACLE_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op6_minhash": minhash.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_merkle": merkle.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
