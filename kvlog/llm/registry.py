"""The corpus queries, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op4_decontamination
from .language import op9_language_id
from .packing import op7_packing
from .quality import op1_quality_classifier
from .secrets import OP3_SQL, op3_secret_scans
from .simhash import op2_simhash_near_dedup
from .tokens import op6_token_counts
from .topk import OP5_SQL, op5_exact_topk
from .toxicity import op10_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash_near_dedup,
        op3_secret_scans,
        op4_decontamination,
        op5_exact_topk,
        op6_token_counts,
        op7_packing,
        op8_warc,
        op9_language_id,
        op10_toxicity,
    )
}
SQL = {"op3_secret_scans": OP3_SQL, "op5_exact_topk": OP5_SQL, "op8_warc": OP8_SQL}
