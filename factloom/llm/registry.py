"""The numbered queries and their SQL."""

from . import alignment, chat, exact_dedup, licenses, packing, quality, repeats, sentencepiece_bpe, sharding, simhash, structure, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_url_filter": url_filter.query,
    "op3_packing": packing.query,
    "op4_quality": quality.query,
    "op5_chat": chat.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_sharding": sharding.query,
    "op8_sentencepiece": sentencepiece_bpe.query,
    "op9_licenses": licenses.query,
    "op10_simhash": simhash.query,
    "op11_suffix_dedup": repeats.query,
    "op12_alignment": alignment.query,
    "op13_structure": structure.query,
}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
