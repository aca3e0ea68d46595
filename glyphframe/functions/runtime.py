"""Versions of what the verbs rest on."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def icu_info(spark: SparkSession) -> dict[str, str]:
    """Versions of Spark, of the Unicode data behind its collations and of the Unicode data of Python kernels."""
    version = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("getUnicodeVersion"))
    return {
        "spark": spark.version,
        "unicode": spark.range(1).select(version).first()[0],
        "kernel_unicode": unicodedata.unidata_version,
        "python": sys.version.split()[0],
    }
