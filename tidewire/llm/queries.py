"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import maxscore
from .extract import op4_extract
from .forest import op9_forest
from .language import op3_language
from .mixing import op10_mixing
from .pieces import op1_pieces
from .quality import op5_quality
from .simhash import op8_simhash
from .toxicity import op2_toxicity
from .wavelet import op7_wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_extract": op4_extract,
    "op5_quality": op5_quality,
    "op6_maxscore": maxscore.op6_maxscore,
    "op7_wavelet": op7_wavelet,
    "op8_simhash": op8_simhash,
    "op9_forest": op9_forest,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op6_maxscore": maxscore.ORACLE}
