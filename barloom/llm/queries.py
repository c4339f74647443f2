"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, exact_dedup, fuzzy_lines, hard_negatives, language, licenses, maxscore, minhash, mixing, packing, secrets, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": licenses.op1_licenses,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_language": language.op7_language,
    "op8_fuzzy_lines": fuzzy_lines.op8_fuzzy_lines,
    "op9_maxscore": maxscore.op9_maxscore,
    "op10_minhash": minhash.op10_minhash,
    "op11_secrets": secrets.op11_secrets,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_repair": conversations.op13_repair,
}
ORACLES: dict[str, str] = {"op1_licenses": licenses.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op6_mixing": mixing.OP6_SQL, "op9_maxscore": maxscore.OP9_SQL, "op11_secrets": secrets.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL, "op13_repair": conversations.OP13_SQL}
