"""The whole analysis of blobs: hashes, type, extension, risk, content. One stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filescope.functions import content
from filescope.operators import detect, extract, rules


def assess(blobs: DataFrame) -> DataFrame:
    """Blobs (file_name, content, ...) with hashes, detection, extension and risk columns, without content extraction."""
    return rules.with_risk(detect.with_extension(detect.with_detection(content.with_hashes(blobs))))


def analyze(blobs: DataFrame) -> DataFrame:
    """As assess(), and `extraction`."""
    return extract.with_extraction(assess(blobs))
