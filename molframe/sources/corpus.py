"""Listing of a molecule folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.constants import STRUCTURE_EXTENSIONS
from molframe.functions.names import clean_name, file_extension
from molframe.sources.text import file_key


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length, modified)`` of the regular files directly in ``directory``; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    return files.select(file_key().alias("path"), "length", F.col("modificationTime").alias("modified"))


def structure_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep molecule files by their cleaned, lower-case extension and add ``file`` and ``ext``."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return (
        files.withColumn("file", name)
        .withColumn("ext", file_extension(clean_name(F.col("file")), F.col("file")))
        .filter(F.col("ext").isin(*STRUCTURE_EXTENSIONS))
    )


def scan_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """The molecule files of a folder, sorted by path."""
    return structure_files(list_files(spark, directory)).orderBy("path")
