"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .bpe import op10_bpe_round_trip
from .decontaminate import op8_decontaminate
from .langid import op12_language_id
from .lm import op4_lm_scores
from .media import op1_media_columns
from .negatives import op11_hard_negatives
from .ngramjoin import op5_ngram_jaccard
from .phrases import op13_collocations
from .sharding import op2_balanced_shards
from .suffixes import op7_repeats
from .tokenfiles import op3_token_files
from .toxicity import op9_toxicity
from .warc import op6_warc_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_balanced_shards": op2_balanced_shards,
    "op3_token_files": op3_token_files,
    "op4_lm_scores": op4_lm_scores,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_warc_segments": op6_warc_segments,
    "op7_repeats": op7_repeats,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {"op5_ngram_jaccard": oracle.COMPONENTS, "op6_warc_segments": oracle.PAGES, "op7_repeats": oracle.REPEATS, "op11_hard_negatives": oracle.NEGATIVES, "op13_collocations": oracle.COLLOCATIONS}
