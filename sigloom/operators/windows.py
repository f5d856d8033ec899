"""Token n-gram windows with keyed 64-bit hashes, bits and validity masks.

One row a window.  Documents are hash-partitioned by id once; masks and per-document sums then need
no further exchange.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import built_wrapping

#: Multiplier of the linear congruential generator that folds tokens and keys.
MULTIPLIER = 6364136223846793005


@dataclass(frozen=True)
class Signal:
    """What a window's bits depend on.

    ``table`` None: bits by repeated mixing of the depth keys; else the bits of a lookup table.
    """

    n: int = 5
    keys: tuple[int, ...] = (7, 11, 13)
    history: int = 64
    table: tuple[int, ...] | None = None
    eos: int | None = None

    @property
    def start(self) -> int:
        """The fold's start value: 1 for table bits, else a digest of the keys."""
        if self.table is not None:
            return 1
        raw = b"".join(struct.pack("<q", k) for k in self.keys)
        return int.from_bytes(hashlib.sha256(raw).digest(), "big") % (2**63 - 1)


class Adapters:
    """Signals by name; a name stands once, and so does a signal."""

    def __init__(self) -> None:
        self._by: dict[str, Signal] = {}

    def register(self, name: str, signal: Signal) -> Signal:
        if name in self._by:
            raise ValueError(f"adapter {name} is there already")
        if signal in self._by.values():
            raise ValueError(f"adapter {name} repeats another one")
        self._by[name] = signal
        return signal

    def __getitem__(self, name: str) -> Signal:
        if name not in self._by:
            raise KeyError(f"no adapter {name}; there are {sorted(self._by)}")
        return self._by[name]

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, n, depth, history, kind) of every adapter."""
        rows = [(k, s.n, len(s.keys), s.history, "mixed" if s.table is None else "table") for k, s in sorted(self._by.items())]
        return spark.createDataFrame(rows, "name string, n int, depth int, history int, kind string")


def n_windows(tokens: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.size(tokens) - (n - 1))


def explode_windows(df: DataFrame, n: int, tokens: str = "tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, pos, gram): every window of n tokens; none for shorter sequences."""
    t = F.col(tokens)
    all_ = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.slice(t, i + 1, n)))
    return df.select(*keep, F.posexplode(all_).alias("pos", "gram"))


def fold(start: Column, values: list[Column]) -> Column:
    """h = (h + v) * M + 1 for each value, in wrapping 64-bit arithmetic."""
    h = start
    for v in values:
        h = (h + v) * F.lit(MULTIPLIER) + F.lit(1)
    return h


def _mixed_bit(key: Column) -> Column:
    a = key
    for _ in range(12):
        a = F.shiftright((a + F.lit(1)) * F.lit(MULTIPLIER) + F.lit(1), 5)
    return F.pmod(F.shiftright(a, 30), F.lit(2)).cast("int")


def signal_windows(df: DataFrame, spark: SparkSession, signal: Signal, tokens: str = "tokens", doc: str = "doc_id") -> DataFrame:
    """(doc, pos, gram, h, keys, g, context_ok, eos_ok, valid) of every window.

    context_ok: the n-1 context tokens' hash isn't among those of the ``history`` windows before (a hash
    of 0 counts as seen until the history has filled).  eos_ok: the window ends before the first end
    token.
    """
    t = F.col(tokens)
    end = F.array_position(t, signal.eos).cast("int") if signal.eos is not None else F.lit(0)
    rows = df.select(doc, tokens, end.alias("end")).repartition(doc)
    cut = explode_windows(rows, signal.n, tokens, keep=(doc, "end"))

    def build() -> DataFrame:
        each = [F.col("gram")[k].cast("long") for k in range(signal.n)]
        start = F.lit(signal.start).cast("long")
        hashed = cut.withColumns({"ctx": fold(start, each[:-1]), "h": fold(start, each)})
        keyed = hashed.withColumn("keys", F.array(*[fold(F.col("h"), [F.lit(k).cast("long")]) for k in signal.keys]))
        depth = range(len(signal.keys))
        if signal.table is None:
            bits = [_mixed_bit(F.col("keys")[d]) for d in depth]
        else:
            # 64 entries a long, so that a table of 65,536 is an array of 1,024.
            longs = [sum(int(b) << i for i, b in enumerate(signal.table[k : k + 64])) for k in range(0, len(signal.table), 64)]
            table = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in longs])
            at = [F.pmod(F.col("keys")[d], F.lit(len(signal.table))).cast("int") for d in depth]
            bits = [F.getbit(F.get(table, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))).cast("int") for i in at]
        return keyed.withColumn("g", F.array(*bits))

    hashed = built_wrapping(spark, build)
    last = F.lag("pos").over(Window.partitionBy(doc, "ctx").orderBy("pos"))
    seen = F.coalesce(F.col("pos") - last <= signal.history, F.lit(False)) | ((F.col("ctx") == 0) & (F.col("pos") < signal.history))
    return hashed.select(
        doc,
        "pos",
        "gram",
        "h",
        "keys",
        "g",
        (~seen).alias("context_ok"),
        ((F.col("end") == 0) | (F.col("pos") + signal.n < F.col("end"))).alias("eos_ok"),
    ).withColumn("valid", F.col("context_ok") & F.col("eos_ok"))


def observations(windows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pos, gram, eligible, occurrence): every window as an observation with a digest of its own, by document, place and tokens."""
    told = F.concat_ws("|", F.col(doc).cast("string"), F.col("pos").cast("string"), F.array_join(F.col("gram").cast("array<string>"), ","))
    return windows.select(doc, "pos", "gram", F.col("valid").alias("eligible"), F.sha2(told, 256).alias("occurrence"))


def exact_context_repeats(df: DataFrame, n: int, history: int, tokens: str = "tokens", doc: str = "doc_id") -> DataFrame:
    """(doc, pos, repeated): whether the very context tokens occur among the ``history`` windows before."""
    cut = explode_windows(df, n, tokens, keep=(doc,)).withColumn("context", F.slice("gram", 1, n - 1))
    last = F.lag("pos").over(Window.partitionBy(doc, "context").orderBy("pos"))
    return cut.select(doc, "pos", F.coalesce(F.col("pos") - last <= history, F.lit(False)).alias("repeated"))


def opportunity(windows: DataFrame, texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: lengths, and how many windows are eligible, repeated or past the end token."""
    counts = windows.groupBy(doc).agg(
        F.count("*").alias("windows"),
        F.count_if("valid").alias("eligible"),
        F.count_if(~F.col("context_ok")).alias("repeated"),
        F.count_if(~F.col("eos_ok")).alias("after_end"),
    )
    lengths = texts.select(doc, F.length(text).cast("long").alias("code_points"), F.octet_length(text).cast("long").alias("bytes"))
    fill = {c: 0 for c in ("windows", "eligible", "repeated", "after_end")}
    return lengths.join(counts, doc, "left").fillna(fill)
