"""Elements of XML files as rows: files are read in splits that end with an element, and each element is parsed by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """A row for each ``tag`` element, with the fields of ``schema`` (attributes begin with _), and ``corrupt``, the text of an element that is no XML.

    The closing tag is the separator of the text reader, so a file of any size spreads over tasks, whatever lines it has. Elements of one
    tag must not hold each other.
    """
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>(?:.(?!<{tag}[\s>]))*$", 0)
    held = raw.select(F.concat(body, F.lit(f"</{tag}>")).alias("_text")).where(F.length("_text") > len(tag) + 3)
    parsed = held.select("_text", F.from_xml("_text", f"{schema}, _corrupt string", {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_x"))
    return parsed.select("_x.*").withColumnRenamed("_corrupt", "corrupt")
