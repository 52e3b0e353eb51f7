"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import bpe, classifier, extraction, licences, media, packing, rules, simhash, suffixes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (warc.op1_warc, bpe.op2_bpe, media.op3_media, licences.op4_licences, packing.op5_packing, simhash.op6_simhash, classifier.op7_classifier, extraction.op8_extraction, rules.op9_rules, suffixes.op10_suffixes, rules.quality_ablations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op9_rules": rules.SQL, "quality_ablations": rules.ABLATIONS_SQL, "op10_suffixes": suffixes.SQL}
