"""The registered queries of this package and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumewatch.llm.alignment import op11_common_ends
from plumewatch.llm.bpe import op1_byte_bpe
from plumewatch.llm.exact import OP6_SQL, op6_content_sort
from plumewatch.llm.language import op9_family_svm
from plumewatch.llm.mixing import op3_water_filling
from plumewatch.llm.phrases import OP12_SQL, op12_prefix_free
from plumewatch.llm.pii import op7_char_crf
from plumewatch.llm.secrets import op10_ownership
from plumewatch.llm.shards import op2_differencing
from plumewatch.llm.simhash import op5_anchor_simhash
from plumewatch.llm.sketches import op13_bottom_k
from plumewatch.llm.tokenfiles import op4_elias_fano
from plumewatch.llm.vectors import op8_metric_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_differencing": op2_differencing,
    "op3_water_filling": op3_water_filling,
    "op4_elias_fano": op4_elias_fano,
    "op5_anchor_simhash": op5_anchor_simhash,
    "op6_content_sort": op6_content_sort,
    "op7_char_crf": op7_char_crf,
    "op8_metric_join": op8_metric_join,
    "op9_family_svm": op9_family_svm,
    "op10_ownership": op10_ownership,
    "op11_common_ends": op11_common_ends,
    "op12_prefix_free": op12_prefix_free,
    "op13_bottom_k": op13_bottom_k,
}
SQL: dict[str, str] = {"op6_content_sort": OP6_SQL, "op12_prefix_free": OP12_SQL}
