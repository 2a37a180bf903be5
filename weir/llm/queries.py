"""The corpus operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import fingerprints, jaccard, lexical, licenses, mixing, packing, pages, quality, substring, suffix, topk, toxicity, whitening
from weir.llm.common import table


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_licenses": licenses.op2_licenses,
    "op3_quality": quality.op3_quality,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_mixing": mixing.op5_mixing,
    "op6_topk": topk.op6_topk,
    "op7_substring": substring.op7_substring,
    "op8_suffix": suffix.op8_suffix,
    "op9_packing": op9_packing,
    "op10_pages": pages.op10_pages,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_lexical": lexical.op12_lexical,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {
    "op4_jaccard": jaccard.SQL,
    "op5_mixing": mixing.SQL,
    "op6_topk": topk.SQL,
    "op7_substring": substring.SQL,
    "op12_lexical": lexical.SQL,
}
