"""Registry of this subpackage's queries and of the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import ann, secrets, suffixes
from strataflow.llm.ann import op8_one_bit_codes
from strataflow.llm.bpe import op10_bpe
from strataflow.llm.decontaminate import op5_template_decontamination
from strataflow.llm.importance import op6_importance_resampling
from strataflow.llm.langid import op2_language_id
from strataflow.llm.pii import op4_pii
from strataflow.llm.secrets import op3_secret_ledger
from strataflow.llm.shards import op1_training_shards
from strataflow.llm.simhash import op7_simhash_near_dedup
from strataflow.llm.suffixes import op9_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_shards": op1_training_shards,
    "op2_language_id": op2_language_id,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_pii": op4_pii,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_one_bit_codes": op8_one_bit_codes,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {"op3_secret_ledger": secrets.ORACLE_SQL, "op8_one_bit_codes": ann.ORACLE_SQL, "op9_suffix_dedup": suffixes.ORACLE_SQL}
