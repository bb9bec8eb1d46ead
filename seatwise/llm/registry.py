"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import chat, exact_dedup, licenses, line_dedup, lm, minhash, mixing, packing, quality, resample, simhash, warc, yinyang

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_lm_score": lm.op2_lm_score,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat": chat.op7_chat,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_resample": resample.op11_resample,
    "op12_minhash": minhash.op12_minhash,
    "op13_compress": yinyang.op13_compress,
}
ORACLES = {
    "op7_chat": chat.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_resample": resample.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_compress": yinyang.ORACLE,
}
