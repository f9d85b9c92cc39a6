"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op9_chat_formatting
from .lexical import op13_ranked_lexical_search
from .lines import op8_quality_classifier
from .media import op10_media_columns
from .mixing import op7_mixing
from .neardup import op6_minhash_near_dedup
from .packing import op2_packing
from .repeats import op5_suffix_array_dedup
from .rules import op1_quality_rules
from .runs import op11_periodic_run_detection
from .sharding import op4_sharding
from .sql import SQL
from .toxicity import op3_toxicity
from .urls import op12_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_toxicity, op4_sharding, op5_suffix_array_dedup, op6_minhash_near_dedup, op7_mixing, op8_quality_classifier, op9_chat_formatting, op10_media_columns, op11_periodic_run_detection, op12_url_filters, op13_ranked_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
