"""Toxicity by multiple-instance learning: a text is toxic if some sentence is.

A linear score of a sentence's words gives its probability; noisy-or over the sentences gives the
text's.  Weights come from labels of whole texts only, by gradient ascent on their likelihood; the
sentence probabilities then locate what offends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_map
from .words import split_words, text_slices, with_text

#: Labelled rows at most that the weights are fitted on, those least by the hash of their id, and words of
#: these rows at most: of the sample's longest texts, those go that lie beyond.
TRAIN_ROWS, TRAIN_WORDS = 4_000, 4_000_000
#: Features are numbered by hash: a word has itself and its beginnings of these lengths.
FEATURES = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
PER_WORD = 1 + len(BEGINNINGS)
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’…¡¿"


def _features(word: str) -> list[int]:
    """The word and its beginnings; a word too short for one repeats itself (counted once)."""
    word = word.strip(_EDGES)
    whole = zlib.crc32(word.encode()) % FEATURES
    return [whole] + [zlib.crc32(f"{word[:n]}-".encode()) % FEATURES if len(word) > n else -1 for n in BEGINNINGS]


def _sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of distinct words, words, first word of each sentence, first sentence of each text and the end)."""
    offsets, coded = split_words(texts, lower=True)
    distinct = coded.dictionary.to_pylist()
    features = np.array([_features(w) for w in distinct], np.int32).reshape(-1, PER_WORD)
    ends = np.fromiter((w.rstrip("\"')»”’]").endswith((".", "!", "?")) for w in distinct), bool, len(distinct))
    codes = coded.indices.to_numpy()
    first = np.zeros(len(codes) + 1, bool)
    first[1:] = ends[codes]
    first[offsets] = True
    starts = np.flatnonzero(first[:-1])
    return features, codes, starts, np.searchsorted(starts, offsets)


def _reduce(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values from each start to the next."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[np.append(starts[1:], size)] - sums[starts] if len(starts) else np.zeros(0)


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.numbers = np.array(sorted(weights), np.int32)
        self.values = np.array([weights[k] for k in sorted(weights)], np.float64)
        self.bias = bias

    def table(self) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.numbers] = self.values
        return out


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(texts: pa.Array, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, sentence scores, first words, first sentences)."""
    features, words, starts, of_text = _sentences(texts)
    by_word = np.where(features >= 0, table[features], 0.0).sum(1)
    sums = np.add.reduceat(by_word[words], starts) if len(starts) else np.zeros(0)
    each = _probability(sums + bias)
    clean = _reduce(np.log1p(-each), of_text[:-1], len(each)) if len(of_text) > 1 else np.zeros(0)
    whole = np.where(np.diff(of_text) > 0, -np.expm1(np.minimum(clean, 0)), 0.0)
    return whole, each, starts, of_text


def _sums(index: np.ndarray, values: np.ndarray, at: np.ndarray, size: int, block: int = 1 << 20) -> np.ndarray:
    """Sums of values[at] by index, in blocks: what is gathered at once stays small."""
    out = np.zeros(size)
    for k in range(0, len(index), block):
        out += np.bincount(index[k : k + block], values[at[k : k + block]], size)
    return out


def _ascend(word, sentence, text, y, w, bias, rounds, sparse) -> tuple[np.ndarray, float]:
    """Gradient ascent on the likelihood of the texts' labels, with shrinking towards zero weights."""
    count, texts = len(text), int(text.max(initial=-1)) + 1
    past_w, past_b = np.full(len(w), 1e-3), 1e-3
    for _ in range(rounds):
        each = _probability(_sums(sentence, w, word, count) + bias)
        clean = np.bincount(text, np.log1p(-each), texts)[text]
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        g = each * (y * np.exp(clean) / toxic - (1 - y))
        gw, gb = _sums(word, g, sentence, len(w)), g.sum()
        past_w += gw * gw
        past_b += gb * gb
        step = 0.3 / np.sqrt(past_w)
        w = w + step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        bias += 0.3 * gb / np.sqrt(past_b)
    return w, bias


def train(numbers: list[np.ndarray], starts: list[np.ndarray], labels: np.ndarray, rounds: int = 200, least: int = 4, sparse: float = 1.0) -> Model:
    """Weights from texts (features of every word, and sentence starts) and their labels.

    Features of fewer than ``least`` texts have no weight.  Without both labels the score is the same
    for all texts.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model({}, 30.0 if share else -30.0)
    seen = np.zeros(FEATURES, np.int32)
    for x in numbers:
        seen[np.unique(x[x >= 0])] += 1
    known = np.flatnonzero(seen >= least)
    column = np.full(FEATURES, -1, np.int32)
    column[known] = np.arange(len(known))
    word, sentence, text = [], [], []
    count = 0
    for i, (x, s) in enumerate(zip(numbers, starts, strict=True)):
        if not len(s):
            continue
        of = np.zeros(len(x) // PER_WORD, np.int64)
        of[s[1:]] = 1
        of = np.repeat(of.cumsum(), PER_WORD)
        w = np.where(x >= 0, column[x], -1)
        word.append(w[w >= 0])
        sentence.append((of + count)[w >= 0].astype(np.int32))
        text.append(np.full(len(s), i))
        count += len(s)
    word, sentence, text = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, sentence, text))
    y_of = labels.astype(float)[text]
    w, bias = _ascend(word, sentence, text, y_of, np.zeros(len(known)), -4.0, rounds, sparse)
    # Shrinking picks the features; a second run gives those their full weights.
    picked = np.flatnonzero(w)
    again = np.full(len(known), -1, np.int32)
    again[picked] = np.arange(len(picked))
    on = again[word] >= 0
    w, bias = _ascend(again[word[on]], sentence[on], text, y_of, w[picked], bias, rounds, sparse / 10)
    known = known[picked]
    return Model({int(k): float(v) for k, v in zip(known, w, strict=True) if abs(v) > 1e-3}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, most_words: int = TRAIN_WORDS) -> Model:
    """Fit on at most ``rows`` labelled whole texts, the shortest of them that together have at most ``most_words`` words.

    ``labels`` has one row an id (of several the greatest label counts); null ids and labels are left
    out.  One task trains; the driver gets weights alone.
    """
    some = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    some = some.groupBy(F.col(doc_id).alias("▁id")).agg(F.max(F.col(label).cast("int")).alias("▁y"))
    some = some.orderBy(F.xxhash64("▁id"), "▁id").limit(rows)
    rows_ = docs.select(F.col(doc_id).alias("▁id"), F.col(text).alias("▁text")).join(F.broadcast(some), "▁id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1, 2 << 20):
            features, words, starts, of_text = _sentences(texts)
            first = np.append(starts, len(words))[of_text]
            xs = [features[words[a:b]].ravel() for a, b in zip(first, first[1:])]
            ss = [starts[a:b] - w for a, b, w in zip(of_text, of_text[1:], first)]
            columns = [pa.array(np.diff(first), pa.int64()), pa.array(xs, pa.list_(pa.int32())), pa.array(ss, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["y", "h", "n", "x", "s"])

    told = rows_.select(F.col("▁y").alias("y"), F.col("▁text").alias("text"), F.xxhash64("▁id").alias("h"))
    told = arrow_map(told, run, "y int, h long, n long, x array<int>, s array<int>")
    # At most ``rows`` rows, so one task may order them.
    within = F.sum("n").over(Window.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, 0)) <= most_words
    told = told.withColumn("within", within).where("within").drop("within")
    weights = told.groupBy(F.lit(0).alias("all")).applyInArrow(_train_table, "number int, value double").collect()
    found = {r["number"]: r["value"] for r in weights}
    return Model({k: v for k, v in found.items() if k >= 0}, found.get(-1, -30.0))


def _train_table(got: pa.Table) -> pa.Table:
    """(number, value) of the weights; number -1 has the bias."""
    got = got.sort_by("h")
    x, s = ([v.values.to_numpy(zero_copy_only=False) for v in got.column(c)] for c in ("x", "s"))
    model = train(x, s, got.column("y").to_numpy())
    return pa.table({"number": pa.array(np.append(model.numbers, -1).astype(np.int32)), "value": pa.array(np.append(model.values, model.bias))})


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offend: float = 0.5, into: tuple[str, str] = ("score", "sentences")) -> DataFrame:
    """The columns ``keep``, ``score`` and ``sentences``: (start, end, score) of those that offend.

    ``score`` is the noisy-or over all sentences of the whole text, 0 for a null or blank one.
    Positions are code points.  Rows are independent; other columns are ignored.  ``into`` names the two
    new columns; kept columns of these names are replaced.
    """
    keep = tuple(c for c in keep if c not in into)
    span = T._parse_datatype_string("array<struct<start:int,end:int,score:double>>")
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(into[0], T.DoubleType()), T.StructField(into[1], span)])
    sent, at = with_text(df, text, keep)
    numbers, values, bias = model.numbers, model.values, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        table = np.zeros(FEATURES)
        table[numbers] = values
        word = re.compile(r"[^ \t-\r]+")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch, texts in text_slices(batches, at, 2 << 20):
            whole, each, starts, of_text = score_texts(texts, table, bias)
            bad = [[] for _ in range(len(whole))]
            where = np.flatnonzero(each >= offend)
            for i in np.unique(np.searchsorted(of_text, where, side="right") - 1):
                spans = [m.span() for m in word.finditer(texts[i].as_py())]
                own = starts[of_text[i] : of_text[i + 1]] - starts[of_text[i]]
                stops = np.append(own[1:], len(spans))
                for j in where[(where >= of_text[i]) & (where < of_text[i + 1])] - of_text[i]:
                    bad[i].append({"start": spans[own[j]][0], "end": spans[stops[j] - 1][1], "score": float(each[of_text[i] + j])})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(whole), pa.array(bad, kind)], names=out.names)

    return arrow_map(sent, run, out)
