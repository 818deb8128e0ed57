"""Text lines with their place in the file, read in splits."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

HEAD_BYTES = 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _first_line(path: str) -> str:
    files, name = opened(path)
    head = b""
    with files.open_input_stream(name) as f:
        while b"\n" not in head and (block := f.read(HEAD_BYTES)):
            head += block
    return head.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8", "replace")


def _first_lines(files: pa.Array) -> pa.Array:
    coded = files.dictionary_encode()
    return pa.array([_first_line(f) for f in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


#: The first line of the file at a path, which is opened once a batch of rows; not repeated by the optimizer.
first_lines = F.arrow_udf(_first_lines, StringType()).asNondeterministic()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``_split``, ``_read`` (order inside a split) and ``value``; a missing path has no lines."""
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file STRING, _split BIGINT, _read BIGINT, value STRING")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_read"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` and ``value``; the number grows with the position in the file, from 1.

    It is the offset of the line's split plus its number within the split. A split has no
    more lines than bytes, so numbers of different splits never meet. Files of a folder are
    numbered each by itself.
    """
    inside = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_read"))
    return text_lines(spark, path).select("file", (F.col("_split") + inside).alias("line_no"), "value")
