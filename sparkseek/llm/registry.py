"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP3_SQL, op3_chat_formatting
from .decontaminate import op6_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .pieces import op9_sentencepiece
from .quality import op4_quality
from .sharding import op10_sharding
from .simhash import op1_simhash
from .toxicity import op7_toxicity
from .url_filter import OP5_SQL, op5_url_filter
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op5_url_filter": OP5_SQL, "op8_exact_dedup": OP8_SQL}
