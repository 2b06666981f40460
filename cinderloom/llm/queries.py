"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .classifier import op9_quality_classifier
from .dedup import OP10_SQL, op10_exact_dedup
from .importance import OP11_SQL, op11_importance
from .mixing import OP8_SQL, op8_mix
from .ngram_join import OP2_SQL, op2_ngram_join
from .pii import op5_pii
from .quality import OP4_SQL, op4_quality_rules
from .suffix_dedup import op3_suffix_dedup
from .tokencount import op7_token_counts
from .tokenfile import op6_token_files
from .treebpe import op13_byte_bpe
from .vectorcode import OP12_SQL, op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_mix": op8_mix,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_importance": op11_importance,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op4_quality_rules": OP4_SQL, "op8_mix": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_importance": OP11_SQL, "op12_vector_codes": OP12_SQL}
