"""Files as they come in: checks of content, dates in names, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.dates import file_name_parts

MOST_BYTES = 100 * 1024 * 1024
#: How files of each kind begin, in hexadecimal.
SIGNATURES = {"pdf": ("25504446",), "png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def file_problem(path: Column | str, length: Column | str, content: Column | str) -> Column:
    """Why a file is refused, null if it isn't: its size, its kind, or a beginning that isn't of its kind."""
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    begins = F.lit(False)
    for name, heads in SIGNATURES.items():
        for head in heads:
            begins = begins | ((kind == name) & F.hex(F.substring(content, 1, len(head) // 2)).eqNullSafe(F.lit(head)))
    return F.when(F.col(length) > MOST_BYTES, "too large").when(~kind.isin(*SIGNATURES), "unknown kind").when(~begins, "content is not of that kind")


def bulk_files(files: DataFrame, *, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` files by name, as rows with ``day, lab, sha256``, and those that can't be taken with a reason."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    taken = files.select("path").orderBy("path").limit(most).withColumn("_taken", F.lit(True))
    taken = files.join(F.broadcast(taken), "path", "left").withColumn("name", name).withColumn("_parts", file_name_parts("name"))
    too_many = F.when(F.col("_taken").isNull(), f"beyond {most} files")
    problem = F.coalesce(too_many, file_problem("path", "length", "content"), F.when(~F.col("_parts.ok"), "no date in the name"))
    told = taken.withColumn("reason", problem)
    good = told.where("reason IS NULL").select("path", "name", "_parts.day", "_parts.lab", F.sha2("content", 256).alias("sha256"))
    return good, told.where("reason IS NOT NULL").select("path", "name", "reason")


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, quoted where needed; one file for each partition."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def overwrite_children(rows: DataFrame, path: str, *, by: str) -> None:
    """Replace the partitions of the parents that ``rows`` has, and no others; a second run changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
