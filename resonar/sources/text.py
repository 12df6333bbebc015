"""Records from text files and commands, and results back to files."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(lines: DataFrame, nul: bool) -> DataFrame:
    """raw (binary) and display (text with invalid bytes replaced)."""
    raw = F.col("value").cast("binary")  # a text function would replace bytes that are no UTF-8
    if nul:
        lines = lines.where(F.octet_length("value") > 0)
    else:
        raw = F.when(F.substring(raw, -1, 1) == F.lit(b"\r"), F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    return lines.select(raw.alias("raw")).select("raw", F.make_valid_utf8(F.col("raw").cast("string")).alias("display"))


def read_records(spark: SparkSession, path: str, *, nul: bool = False) -> DataFrame:
    """Lines of files: only a line feed ends one, one carriage return before it goes, empty lines stay. nul: records end with NUL, empty ones go."""
    return _records(spark.read.option("lineSep", "\0" if nul else "\n").text(path), nul)


def read_record_stream(spark: SparkSession, path: str, *, nul: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """The same of files that arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\0" if nul else "\n").option("maxFilesPerTrigger", files_per_trigger)
    return _records(reader.text(path), nul)


def records_of(spark: SparkSession, data: bytes, *, nul: bool = False) -> DataFrame:
    """Records of bytes that the driver holds."""
    if nul:
        parts = [x for x in data.split(b"\0") if x]
    else:
        parts = data.split(b"\n")
        parts = parts[:-1] if parts[-1] == b"" else parts
        parts = [x[:-1] if x.endswith(b"\r") else x for x in parts]
    return spark.createDataFrame([(bytearray(x), x.decode("utf-8", "replace"), k) for k, x in enumerate(parts)], "raw binary, display string, pos long")


def command_records(spark: SparkSession, command: str, *, nul: bool = False) -> DataFrame:
    """What a shell command prints; a failing command is an error."""
    done = subprocess.run([os.environ.get("SHELL", "sh"), "-c", command], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command!r} ended with {done.returncode}: {done.stderr.decode(errors='replace')}")
    return records_of(spark, done.stdout, nul=nul)


def choose_source(*, path: str | None = None, stdin: bytes | None = None, walk: bool = False, command: str | None = None) -> str:
    """Which source a call uses: a file, non-empty input, an asked-for walk, a default command, empty input, else a walk."""
    if path is not None:
        return "file"
    if stdin:
        return "stdin"
    if walk:
        return "walker"
    if command:
        return "command"
    return "stdin" if stdin is not None else "walker"


def write_records(outputs: DataFrame, path: str, *, column: str = "output", nul: bool = False) -> None:
    """Writes records, each ended by a line feed or NUL. The order within a file is that of the rows."""
    outputs.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\0" if nul else "\n").text(path)


def ordered_bytes(outputs: DataFrame, *, column: str = "output", nul: bool = False) -> bytes:
    """A small ordered result as bytes; rows come to the driver one partition at a time."""
    end = b"\0" if nul else b"\n"
    return b"".join(bytes(r[column]) + end for r in outputs.select(column).toLocalIterator())
