"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import contexttree, decontaminate, languages, mixing, phrases, quotes, ranking, repeats, secrets, simhash, suffixes, tiff, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_contexttree": contexttree.op2,
    "op3_quotes": quotes.op3,
    "op4_repeats": repeats.op4,
    "op5_languages": languages.op5,
    "op6_simhash": simhash.op6,
    "op7_tiff": tiff.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_mixing": mixing.op9,
    "op10_secrets": secrets.op10,
    "op11_maxscore": ranking.op11,
    "op12_suffixes": suffixes.op12,
    "op13_phrases": phrases.op13,
}
ORACLE = {"op3_quotes": quotes.SQL, "op4_repeats": repeats.SQL, "op9_mixing": mixing.SQL, "op11_maxscore": ranking.SQL, "op12_suffixes": suffixes.SQL, "op13_phrases": phrases.SQL}
