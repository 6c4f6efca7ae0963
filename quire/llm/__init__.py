"""Training-data operators: classifiers, near-duplicate joins, mixing, tokenisation.

``queries()`` and ``oracle_sql()`` list the thin ``opN_<name>`` queries; each module holds one
operator with its own general interface.  Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from importlib import import_module

#: query name -> module; each module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_mix": "mixing",
    "op3_embedding_dedup": "embedding_dedup",
    "op4_token_output": "token_output",
    "op5_sentencepiece": "sentencepiece_codec",
    "op6_quality_rules": "quality_rules",
    "op7_ngram_jaccard": "ngram_jaccard",
    "op8_token_counts": "token_counts",
    "op9_quality_classifier": "quality_classifier",
    "op10_line_dedup": "line_dedup",
    "op10_line_dedup_scaled": "line_dedup_scaled",
    "op11_bpe_words": "bpe_words",
    "op12_token_alignment": "token_alignment",
    "op13_periodic_runs": "periodic_runs",
}


def queries() -> dict:
    def lazy(module: str):
        return lambda spark, sf_dir: import_module(f"{__name__}.{module}").query(spark, sf_dir)

    return {name: lazy(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
