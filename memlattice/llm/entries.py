"""The corpus operators' queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP1_SQL, op1_decontaminate
from .filter_audit import OP12_SQL, op12_filter_audit
from .language_model import op6_lm_scoring
from .licenses import op13_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import OP8_SQL, op8_mixing
from .near_dedup import OP5_SQL, op5_minhash_near_dedup
from .neighbours import OP9_SQL, op9_nearest_neighbours
from .preferences import OP4_SQL, op4_preference_format
from .quality import op7_quality_classifier
from .secrets import op3_secret_scan
from .spelling import OP11_SQL, op11_spelling_variants
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_preference_format": op4_preference_format,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing": op8_mixing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}

SQL = {"op1_decontaminate": OP1_SQL, "op4_preference_format": OP4_SQL, "op5_minhash_near_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op9_nearest_neighbours": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_filter_audit": OP12_SQL}
