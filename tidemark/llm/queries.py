"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidemark.llm import centroids, chat, exact_dedup, flac, lexical, licenses, line_dedup, packing, quality, rans, sentencepieces, simhash, warc


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_sentencepiece": sentencepieces.op2_sentencepiece,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_token_files": rans.op5_token_files,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_flac": flac.op7_flac,
        "op8_packing": packing.op8_packing,
        "op9_warc": warc.op9_warc,
        "op10_quality": quality.op10_quality,
        "op11_chat": chat.op11_chat,
        "op12_centroids": centroids.op12_centroids,
        "op13_lexical": lexical.op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE, "op9_warc": warc.ORACLE, "op11_chat": chat.ORACLE, "op12_centroids": centroids.ORACLE, "op13_lexical": lexical.ORACLE}
