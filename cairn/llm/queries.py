"""The queries of this subpackage, and SQL for those that SQL can express."""

from cairn.llm import decontaminate, fingerprint, language_id, merkle, mixing, ngram_join, pii, quality, sentence_dedup, spelling, token_counts, toxicity, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_warc": warc.op7_warc,
    "op8_sentence_dedup": sentence_dedup.op8_sentence_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_spelling": spelling.op11_spelling,
    "op12_merkle": merkle.op12_merkle,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = warc.ORACLE | spelling.ORACLE | merkle.ORACLE
