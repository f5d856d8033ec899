"""Strict JSON and CSV, source pins, run manifests."""

from __future__ import annotations

import hashlib
import json
import math
import platform
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> object:
    """Sorted text keys, lists for tuples, sets in order of their own JSON, 0.0 for -0.0; NaN is refused."""
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise TypeError("keys must be text")
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=canonical_json)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("numbers must be finite")
        return 0.0 if value == 0 else value
    return value


def canonical_json(value: object) -> str:
    return json.dumps(canonical(value), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def derive_seed(master: int, parts: list, bits: int = 64) -> int:
    return int(sha256_json({"master_seed": master, "parts": parts}), 16) % (1 << bits)


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("DUPLICATE_KEY")
    return out


def check_json(raw: str, fields: list[str] | None, max_bytes: int, must_be_canonical: bool) -> str | None:
    """What is wrong with a JSON object: null if nothing."""
    if len(raw.encode()) > max_bytes:
        return "TOO_LARGE"
    try:
        value = json.loads(raw, object_pairs_hook=_once)
    except ValueError as e:
        return "DUPLICATE_KEY" if "DUPLICATE_KEY" in str(e) else "NOT_JSON"
    if not isinstance(value, dict):
        return "NOT_AN_OBJECT"
    if fields is not None and set(value) != set(fields):
        return "FIELDS_DIFFER"
    try:
        same = canonical_json(value) == raw
    except (TypeError, ValueError):
        return "NOT_CANONICAL"
    return "NOT_CANONICAL" if must_be_canonical and not same else None


def read_json(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = 1 << 24, must_be_canonical: bool = False) -> DataFrame:
    """Rows of strict JSON lines: ``raw``, ``problem`` (null if none) and ``row``, the parsed struct.

    Duplicate keys, missing or extra fields, size and, on demand, canonical form are checked by line.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"))
    checked = checked_json(lines, "raw", schema.fieldNames(), max_bytes, must_be_canonical)
    return checked.withColumn("row", F.when(F.col("problem").isNull(), F.from_json("raw", schema, {"mode": "FAILFAST"})))


def checked_json(df: DataFrame, column: str, fields: list[str] | None, max_bytes: int = 1 << 24, must_be_canonical: bool = False) -> DataFrame:
    """(raw, problem) of a column of JSON objects: null where nothing is wrong; a null text is NOT_JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = ["NOT_JSON" if x is None else check_json(x, fields, max_bytes, must_be_canonical) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.string())], names=["raw", "problem"])

    return df.select(F.col(column).alias("raw")).mapInArrow(run, "raw string, problem string")


def write_csv(df: DataFrame, path: str) -> None:
    """A flat report with a header; Spark's commit protocol makes it whole or absent."""
    df.write.mode("overwrite").option("header", True).csv(path)


def canonical_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: every row as canonical JSON (sorted keys, no blanks, nulls kept, no NaN or infinity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical_json(r) for r in b.to_pylist()], pa.string())], names=["value"])

    return df.mapInArrow(run, "value string")


def write_json(df: DataFrame, path: str) -> None:
    """Canonical JSON lines; Spark's commit protocol makes the folder whole or absent."""
    canonical_rows(df).write.mode("overwrite").text(path)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files that a path names, read as whole bytes on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def pins(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(source_id, repository, revision) of pinned sources; an id may stand only once."""
    df = spark.createDataFrame(rows, "source_id string, repository string, revision string")
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a source is pinned twice")
    return df


def drifted(pinned: DataFrame, observed: DataFrame) -> DataFrame:
    """Pins whose observed revision differs or is missing."""
    seen = observed.select("source_id", F.col("revision").alias("observed"))
    return pinned.join(seen, "source_id", "left").where(~F.col("revision").eqNullSafe(F.col("observed")))


def environment(spark: SparkSession, seed: int) -> DataFrame:
    """One row: versions, seed, commit and whether the tree has changes."""
    def git(*a: str) -> str | None:
        try:
            return subprocess.run(["git", *a], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    dirty = git("status", "--porcelain")
    row = (platform.python_version(), spark.version, pa.__version__, platform.platform(), seed, git("rev-parse", "HEAD"), None if dirty is None else bool(dirty))
    return spark.createDataFrame([row], "python string, spark string, arrow string, platform string, seed long, commit string, dirty boolean")


#: Which states of a run may follow which.
NEXT = {None: {"AUTHORIZED"}, "AUTHORIZED": {"STARTED", "INVALIDATED"}, "STARTED": {"COMPLETED", "INVALIDATED"}, "COMPLETED": set(), "INVALIDATED": set()}


def broken_ledger(events: DataFrame, run: str = "run", order: str = "seq", state: str = "state") -> DataFrame:
    """Ledger events that may not follow the one before."""
    from pyspark.sql.window import Window

    before = F.lag(state).over(Window.partitionBy(run).orderBy(order))
    told = events.withColumn("before", before)
    fine = F.lit(False)
    for last, after in NEXT.items():
        is_last = F.col("before").isNull() if last is None else F.col("before").eqNullSafe(last)
        fine = fine | (is_last & F.col(state).isin(*after) if after else F.lit(False))
    return told.where(~fine)
