"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .collocations import OP13_SQL, op13_collocations
from .knn import OP10_SQL, op10_top_k
from .language import op6_language
from .license_scan import op9_license_scans
from .minhash import op1_minhash
from .mixing import OP5_SQL, op5_mixing
from .sketch import op4_fingerprints
from .pieces import op12_pieces
from .spelling import OP11_SQL, op11_spelling
from .substring_dedup import op8_suffix_array
from .toxicity import op2_toxicity
from .url_filter import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_url_filters": op3_url_filters,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_suffix_array": op8_suffix_array,
    "op9_license_scans": op9_license_scans,
    "op10_top_k": op10_top_k,
    "op11_spelling": op11_spelling,
    "op12_pieces": op12_pieces,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op3_url_filters": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op10_top_k": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
