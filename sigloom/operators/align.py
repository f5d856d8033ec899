"""Canonical token alignment of document pairs, and what windows survive it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..functions.text import content_words, tokens
from ..scratch import keep as keep_table
from .windows import Signal, signal_windows

_INTS = T.ArrayType(T.IntegerType())
ALIGNMENT = T.StructType(
    [
        T.StructField("distance", T.IntegerType()),
        T.StructField("ties", T.IntegerType()),
        T.StructField("ops", T.StringType()),
        T.StructField("matched", _INTS),
        T.StructField("placed", _INTS),
    ]
)
#: Cells of a band kept at a time; of larger bands some rows are kept, and the rest made again from these.
MAX_CELLS = 16_000_000
_FAR = 1 << 29


def _banded(a: np.ndarray, b: np.ndarray, w: int, above: np.ndarray | None, first: int, last: int, every: int = 1) -> np.ndarray:
    """Unit-cost edit distances of prefixes (i, i - w .. i + w), for i from ``first`` to ``last``.

    ``above`` is row ``first``, None for row 0.  Of the rows, each ``every``-th is kept, and the last.
    """
    m = len(b)
    width = 2 * w + 1
    step = np.arange(width, dtype=np.int32)
    d = np.full(((last - first) // every + 1 + ((last - first) % every > 0), width), _FAR, np.int32)
    if above is None:
        above = np.full(width, _FAR, np.int32)
        above[w : w + min(m, w) + 1] = np.arange(min(m, w) + 1)
    d[0] = above
    for i in range(first + 1, last + 1):
        low, high = max(0, i - w), min(m, i + w)
        row = np.full(width, _FAR, np.int32)
        if low <= high:
            k = slice(low - i + w, high - i + w + 1)
            inner = slice(max(1, low) - i + w, high - i + w + 1)
            row[inner] = above[inner] + (b[max(1, low) - 1 : high] != a[i - 1])
            row[:-1] = np.minimum(row[:-1], above[1:] + 1)
            if low == 0:
                row[w - i] = i
            row[k] = np.minimum.accumulate(row[k] - step[k]) + step[k]
            # Outside the text, what the rows above reach is no prefix.
            row[: k.start] = row[k.stop :] = _FAR
        if i == last or not (i - first) % every:
            d[-1 if i == last else (i - first) // every] = row
        above = row
    return d


class _Band:
    """Rows of a band, asked for from the last to the first, ``cells`` of them or so kept at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: int, cells: int):
        self.a, self.b, self.w = a, b, w
        self.rows = max(3, cells // (2 * w + 1))
        #: (first, last, every, kept rows): each part lies between two kept rows of the part before it.
        self.parts: list[tuple[int, int, int, np.ndarray]] = []
        self._add(None, 0, len(a))

    def _add(self, above: np.ndarray | None, first: int, last: int) -> None:
        every = -(-(last - first) // (self.rows - 1)) or 1
        self.parts.append((first, last, every, _banded(self.a, self.b, self.w, above, first, last, every)))

    def row(self, i: int) -> np.ndarray:
        while True:
            first, last, every, d = self.parts[-1]
            if i < first:
                self.parts.pop()
            elif i == last:
                return d[-1]
            elif not (i - first) % every:
                return d[(i - first) // every]
            else:
                k = (i - first) // every
                self._add(d[k], first + k * every, min(last, first + (k + 1) * every))


def _slide(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> int:
    """How many tokens are equal from (i, j) on, in steps of 1, or before it, in steps of -1."""
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)
    done, size = 0, 8
    while done < most:
        size = min(size * 4, most - done)
        x, y = (a[i + done : i + done + size], b[j + done : j + done + size]) if step > 0 else (a[i - done - size : i - done][::-1], b[j - done - size : j - done][::-1])
        differ = x != y
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
    return done


def _reaches(a: np.ndarray, b: np.ndarray, cells: int) -> list[np.ndarray] | None:
    """For each cost e the furthest row that it reaches on each diagonal -e .. e, until it reaches the end of both.

    On a diagonal costs never fall, so a cell costs at most e if its row is at most the furthest one.  None
    where more than ``cells`` of these would have to be kept.
    """
    n, m = len(a), len(b)
    rows = [np.array([_slide(a, b, 0, 0, 1)], np.int32)]
    while True:
        e = len(rows) - 1
        if abs(m - n) <= e and rows[-1][e + m - n] >= n:
            return rows
        if (e + 2) ** 2 > cells:
            return None
        e += 1
        k = np.arange(-e, e + 1, dtype=np.int32)
        last = np.full(2 * e + 3, -2, np.int32)
        last[2 : 2 * e + 1] = rows[-1]
        # Substitute along the diagonal, insert from the one below, delete from the one above.
        i = np.maximum(np.maximum(last[1:-1] + 1, last[:-2]), last[2:] + 1)
        i = np.minimum(i, np.minimum(n, m - k))
        i[(i < 0) | (i + k < 0)] = -2
        inside = np.flatnonzero((i >= 0) & (i < n) & (i + k < m))
        for x in inside[a[i[inside]] == b[i[inside] + k[inside]]].tolist():
            i[x] += _slide(a, b, int(i[x]), int(i[x] + k[x]), 1)
        rows.append(i)


def align(a: np.ndarray, b: np.ndarray, cells: int = MAX_CELLS) -> dict:
    """The minimum-cost alignment; of equal ones, from the end: diagonal, else delete, else insert.

    ops has one letter a step (M, S, D, I); ties counts the other choices of equal cost along the path;
    matched and placed have -1 for tokens without a place.  Pairs of any length are aligned: work grows
    with the square of the distance, not of the length, as long as ``cells`` hold it, and else with a band.
    """
    rows = _reaches(a, b, cells)
    if rows is None:
        return _align_banded(a, b, cells)
    n, m = len(a), len(b)
    parts, ties, i, j, e = [], 0, n, m, len(rows) - 1
    matched, placed = np.full(n, -1, np.int32), np.full(n, -1, np.int32)

    def reach(k: int) -> int:
        """The furthest row of diagonal k that one edit less reaches."""
        return int(rows[e - 1][k + e - 1]) if e and abs(k) < e else -2

    while i or j:
        if not i or not j:
            parts.append("D" * i + "I" * j)
            break
        k = j - i
        run = _slide(a, b, i, j, -1)
        if run:
            start = i - run
            matched[start:i] = placed[start:i] = np.arange(start + k, i + k, dtype=np.int32)
            ties += max(0, min(i, reach(k + 1) + 1) - start) + max(0, min(i, reach(k - 1)) - start)
            parts.append("M" * run)
            i, j = start, start + k
            continue
        fits = reach(k) >= i - 1, reach(k + 1) >= i - 1, reach(k - 1) >= i
        ties += sum(fits) - 1
        if fits[0]:
            i, j = i - 1, j - 1
            placed[i] = j
        elif fits[1]:
            i -= 1
        else:
            j -= 1
        parts.append("S" if fits[0] else "D" if fits[1] else "I")
        e -= 1
    return {"distance": len(rows) - 1, "ties": ties, "ops": "".join(reversed(parts)), "matched": matched, "placed": placed}


def _align_banded(a: np.ndarray, b: np.ndarray, cells: int) -> dict:
    """The same by rows of a band that doubles until the distance fits in it."""
    n, m = len(a), len(b)
    w = max(8, abs(n - m))
    while True:
        d = _Band(a, b, w, cells)
        distance = int(d.row(n)[m - n + w])
        if distance <= w or w >= max(n, m):
            break
        w = min(2 * w, max(n, m))

    def at(row: np.ndarray, i: int, j: int) -> int:
        return int(row[j - i + w]) if 0 <= j - i + w <= 2 * w else _FAR

    ops, ties, i, j = [], 0, n, m
    matched, placed = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    row, above = d.row(n), d.row(n - 1) if n else None
    while i or j:
        if not i or not j:
            ops.append("D" if i else "I")
            i, j = (i - 1, j) if i else (i, j - 1)
            continue
        same = a[i - 1] == b[j - 1]
        costs = (at(above, i - 1, j - 1) + (not same), at(above, i - 1, j) + 1, at(row, i, j - 1) + 1)
        best = min(costs)
        ties += sum(c == best for c in costs) - 1
        if costs[0] == best:
            i, j = i - 1, j - 1
            placed[i] = j
            if same:
                matched[i] = j
            ops.append("M" if same else "S")
        elif costs[1] == best:
            i -= 1
            ops.append("D")
        else:
            j -= 1
            ops.append("I")
        if ops[-1] != "I" and i:
            row, above = above, d.row(i - 1)
    return {"distance": distance, "ties": ties, "ops": "".join(reversed(ops)), "matched": matched, "placed": placed}


def distance(a: np.ndarray, b: np.ndarray, cells: int = MAX_CELLS) -> int:
    """The unit-cost edit distance alone."""
    rows = _reaches(a, b, cells)
    return len(rows) - 1 if rows is not None else _align_banded(a, b, cells)["distance"]


def _costs(rows: list[np.ndarray], k: int, n: int) -> np.ndarray:
    """Cost of the cells of diagonal k in rows 0 .. n; what costs more than the whole counts as one more than that."""
    least, most = abs(k), len(rows) - 1
    column = np.array([rows[e][k + e] for e in range(least, most + 1)], np.int64)
    return np.minimum(least + np.searchsorted(np.maximum.accumulate(column), np.arange(n + 1)), most + 1) if len(column) else np.full(n + 1, most + 1)


def ambiguous(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which tokens of the first text some best alignment matches, and another one doesn't or matches elsewhere.

    A cell lies on a best path if its costs from the beginning and from the end add up to the distance;
    only diagonals that the distance reaches can hold one.  Memory grows with the square of the distance (8
    bytes a cell of both tables: 200 MB at 5,000).
    """
    n, m = len(a), len(b)
    there, back = _reaches(a, b, 1 << 62), _reaches(a[::-1], b[::-1], 1 << 62)
    d = len(there) - 1
    matches, other = np.zeros(n, np.int64), np.zeros(n, bool)

    def to_end(k: int) -> np.ndarray:
        """Cost from the cells of diagonal k in rows 0 .. n to the end."""
        return _costs(back, m - n - k, n)[::-1]

    below = to_end(-d - 1) if n else np.zeros(1)
    for k in range(-d, d + 1):
        first, last = max(0, -k), min(n, m - k)
        here = to_end(k)
        if first <= last and n:
            cost = _costs(there, k, n)
            i = np.arange(first, min(last + 1, n))  # rows from which a token can be deleted
            other[i] |= cost[i] + 1 + below[i + 1] == d
            i = np.arange(first, last)
            if len(i):
                equal = a[i] == b[i + k]
                matches[i] += equal & (cost[i] + here[i + 1] == d)
                other[i] |= ~equal & (cost[i] + 1 + here[i + 1] == d)
        below = here
    return (matches > 0) & ((matches > 1) | other)


def _tokens(lists: pa.Array) -> Iterator[np.ndarray]:
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[s:e]


def _places(each: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(each) if each else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32(), mask=flat < 0))


@arrow_udf(ALIGNMENT)
def _align_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [align(x, y) for x, y in zip(_tokens(a), _tokens(b), strict=True)]
    numbers = [pa.array([r[c] for r in out], pa.int32()) for c in ("distance", "ties")]
    columns = [*numbers, pa.array([r["ops"] for r in out], pa.string()), *(_places([r[c] for r in out]) for c in ("matched", "placed"))]
    return pa.StructArray.from_arrays(columns, names=ALIGNMENT.names)


@arrow_udf(T.ArrayType(T.BooleanType()))
def _unsure(a: pa.Array, b: pa.Array) -> pa.Array:
    each = [ambiguous(x, y) for x, y in zip(_tokens(a), _tokens(b), strict=True)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each) if each else np.zeros(0, bool)))


@arrow_udf(T.IntegerType())
def _words_apart(a: pa.Array, b: pa.Array) -> pa.Array:
    both = pa.concat_arrays([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()).cast(pa.large_string()) for x in (a, b)])
    codes = both.dictionary_encode().indices.to_numpy()
    ends = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in (a, b)]
    second = codes[ends[0][-1] :]
    return pa.array([distance(codes[ends[0][k] : ends[0][k + 1]], second[ends[1][k] : ends[1][k + 1]]) for k in range(len(a))], pa.int32())


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts in words of ASCII letters and digits; a null text has none."""
    return _words_apart(content_words(F.coalesce(a, F.lit(""))), content_words(F.coalesce(b, F.lit(""))))


def aligned(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with column ``al``, of texts of any length."""
    # Told to be nondeterministic, so that a filter on it doesn't align every pair a second time.
    return pairs.withColumn("al", _align_batch.asNondeterministic()(a, b))


def with_ambiguity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with column ``unsure``: which tokens of the first text can be matched in more than one way, or not at all."""
    return pairs.withColumn("unsure", _unsure.asNondeterministic()(a, b))


def inverse_maps(pairs: DataFrame, b: str = "b") -> DataFrame:
    """The pairs with ``matched_back`` and ``placed_back``: for each token of the second text its place in the first."""
    back = lambda places: F.transform(F.col(b), lambda _, j: F.nullif(F.array_position(places, j.cast("int")).cast("int") - 1, F.lit(-1)))
    return pairs.withColumns({"matched_back": back(F.col("al.matched")), "placed_back": back(F.col("al.placed"))})


def invalid_alignments(pairs: DataFrame) -> DataFrame:
    """The pairs whose stored ``al`` isn't the canonical alignment of their texts, with the parts that differ."""
    fresh = pairs.withColumn("fresh_", _align_batch.asNondeterministic()("a", "b"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"al.{c}").eqNullSafe(F.col(f"fresh_.{c}")), F.lit(c)) for c in ALIGNMENT.names]))
    return fresh.withColumn("wrong", wrong).drop("fresh_").where(F.size("wrong") > 0)


def conserved_runs(pairs: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(keep, a_start, a_end, b_start, b_end): maximal runs of consecutive matches, ends exclusive."""
    each = pairs.select(*keep, F.posexplode("al.matched").alias("i", "j")).where("j IS NOT NULL")
    # i - j alone can repeat after an insertion and a deletion; a gap in i tells such runs apart.
    w = Window.partitionBy(*keep).orderBy("i")
    fresh = (F.col("i") - F.lag("i").over(w) != 1) | (F.col("j") - F.lag("j").over(w) != 1)
    run = F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w).alias("run")
    runs = each.select(*keep, "i", "j", run).groupBy(*keep, "run")
    ends = runs.agg(F.min("i").alias("a_start"), (F.max("i") + 1).alias("a_end"), F.min("j").alias("b_start"), (F.max("j") + 1).alias("b_end"))
    return ends.drop("run")


def _consecutive(places: Column) -> Column:
    """Whether all places are there and follow one another."""
    first = F.element_at(places, 1)
    return F.forall(places, lambda p: p.isNotNull()) & (F.element_at(places, -1) - first == F.size(places) - 1) & F.forall(F.sequence(F.lit(1), F.size(places)), lambda k: F.element_at(places, k) == first + k - 1)


def window_diffs(pairs: DataFrame, n: int, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(keep, pos, to, state, whole, unsure) of every window of the first text.

    PRESERVED: its tokens match consecutive tokens, from ``to`` on; REPLACED: they only stand at
    consecutive places; UNMAPPED: neither.  ``whole``: every token is matched, wherever.  ``unsure``: some token
    is ambiguous, as told by ``with_ambiguity``; false without it.
    """
    n_windows = F.greatest(F.lit(0), F.size("a") - n + 1)
    cut = lambda c, k: F.slice(c, k + 1, n)
    doubt = (lambda k: F.exists(cut("unsure", k), lambda x: x)) if "unsure" in pairs.columns else (lambda k: F.lit(False))
    # Cut inside the generator: texts beside it would be copied for each of their windows.
    each = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda k: F.struct(k.alias("pos"), cut("al.matched", k).alias("m"), cut("al.placed", k).alias("p"), doubt(k).alias("unsure")))
    rows = pairs.select(*keep, F.explode(F.when(n_windows > 0, each)).alias("w")).select(*keep, "w.*")
    kept, moved = F.coalesce(_consecutive(F.col("m")), F.lit(False)), F.coalesce(_consecutive(F.col("p")), F.lit(False))
    return rows.select(
        *keep,
        "pos",
        F.when(kept | moved, F.element_at(F.when(kept, F.col("m")).otherwise(F.col("p")), 1)).alias("to"),
        F.when(kept, "PRESERVED").when(moved, "REPLACED").otherwise("UNMAPPED").alias("state"),
        F.forall("m", lambda x: x.isNotNull()).alias("whole"),
        "unsure",
    )


def diff_summary(diffs: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Counts and ratios by state, and the share of old windows replaced or unmapped."""
    by = diffs.groupBy(*keep).agg(F.count("*").alias("windows"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("PRESERVED", "REPLACED", "UNMAPPED")])
    n = F.greatest(F.lit(1), F.col("windows"))
    return by.withColumns({"preserved_ratio": F.col("preserved") / n, "replacement_ratio": (F.col("replaced") + F.col("unmapped")) / n})


def broken_maps(diffs: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(keep, pos, to): preserved windows that don't go strictly further than the ones before; none in a sound map."""
    before = F.max("to").over(Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return diffs.where("state = 'PRESERVED'").select(*keep, "pos", "to", before.alias("before")).where("to <= before").drop("before")


def survival(diffs: DataFrame, root: DataFrame, final: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(keep, eligible, survived, newly_masked, unmapped, changed, ambiguous, ratio, destroyed_ratio, status) of each pair.

    ``root`` and ``final`` have (keep, pos, valid) of both texts' windows.  In this order: a window with an
    ambiguous token is told apart; one with a token that nothing matches is unmapped; one whose matches
    aren't consecutive has changed; one that isn't valid any more is newly masked.  A pair without eligible
    windows has ratio 1 and says so.
    """
    old = root.select(*keep, "pos", F.col("valid").alias("was"))
    new = final.select(*keep, F.col("pos").alias("to"), F.col("valid").alias("is"))
    both = diffs.join(old, [*keep, "pos"]).join(new, [*keep, "to"], "left")
    fate = (
        F.when(~F.col("was"), "ROOT_INELIGIBLE")
        .when(F.col("unsure"), "AMBIGUOUS")
        .when(~F.col("whole"), "UNMAPPED")
        .when(F.col("state") != "PRESERVED", "NONCONTIGUOUS_OR_CHANGED")
        .when(~F.coalesce("is", F.lit(False)), "NEWLY_MASKED")
        .otherwise("SURVIVED")
    )
    is_ = lambda name: F.count_if(F.col("fate") == name)
    by = both.withColumn("fate", fate).groupBy(*keep).agg(
        F.count_if("was").alias("eligible"),
        is_("SURVIVED").alias("survived"),
        is_("NEWLY_MASKED").alias("newly_masked"),
        is_("UNMAPPED").alias("unmapped"),
        is_("NONCONTIGUOUS_OR_CHANGED").alias("changed"),
        is_("AMBIGUOUS").alias("ambiguous"),
    )
    some = F.col("eligible") > 0
    return by.withColumns({
        "ratio": F.when(some, F.col("survived") / F.greatest("eligible", F.lit(1))).otherwise(1.0),
        "destroyed_ratio": F.when(some, (F.col("eligible") - F.col("survived")) / F.greatest("eligible", F.lit(1))).otherwise(0.0),
        "status": F.when(some, "OK").otherwise("NO_ELIGIBLE_OBSERVATIONS"),
    })


def residual_geometry(diffs: DataFrame, root: DataFrame, final: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """What is left of a text's valid windows after an edit, and why the rest was lost.

    ``root`` and ``final`` have (keep, pos, context_ok, eos_ok, valid).  Ratios divide by at least 1.
    """
    def counts(windows: DataFrame, name: str) -> DataFrame:
        return windows.groupBy(*keep).agg(
            F.count_if("valid").alias(f"{name}_valid"),
            F.count_if(~F.col("context_ok")).alias(f"{name}_repeated"),
            F.count_if(~F.col("eos_ok")).alias(f"{name}_after_end"),
        )

    exact = diffs.where("state = 'PRESERVED'").join(root.where("valid").select(*keep, "pos"), [*keep, "pos"])
    new = final.select(*keep, F.col("pos").alias("to"), "context_ok", "eos_ok")
    c, e = F.col("context_ok"), F.col("eos_ok")
    lost = exact.join(new, [*keep, "to"]).groupBy(*keep).agg(
        F.count_if(c & e).alias("preserved"),
        F.count_if(~c & e).alias("lost_to_repetition"),
        F.count_if(c & ~e).alias("lost_to_end"),
        F.count_if(~c & ~e).alias("lost_to_both"),
    )
    both = counts(root, "root").join(counts(final, "final"), [*keep], "left").join(lost, [*keep], "left").fillna(0)
    some = lambda c: F.greatest(F.lit(1), F.col(c))
    return both.withColumns({
        "survival_fraction": F.col("preserved") / some("root_valid"),
        "destruction_fraction": 1 - F.col("preserved") / some("root_valid"),
        "inherited_fraction": F.col("preserved") / some("final_valid"),
        "new_fraction": (F.col("final_valid") - F.col("preserved")) / some("final_valid"),
        "denominator_ratio": F.col("final_valid") / some("root_valid"),
        "repetition_delta": F.col("final_repeated") - F.col("root_repeated"),
        "end_delta": F.col("final_after_end") - F.col("root_after_end"),
    })


def strict_gate(geometry: DataFrame, growth_cap: int = 0, least_ratio: float = 0.9, span_violations: Column | None = None, invariants_hold: Column | None = None, fidelity_holds: Column | None = None) -> DataFrame:
    """Reasons why a pair's comparison can't count, sorted; none means eligible.  Checks that aren't given don't speak."""
    fails = lambda c: ~F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(F.col("denominator_ratio") < least_ratio, F.lit("FINAL_VALID_DENOMINATOR_COLLAPSE")),
        F.when(fails(invariants_hold), F.lit("HARD_FIDELITY_INVARIANT_FAILED")),
        F.when(span_violations > 0 if span_violations is not None else F.lit(False), F.lit("PROTECTED_SPAN_VIOLATION")),
        F.when(F.col("repetition_delta") > growth_cap, F.lit("REPETITION_MASK_GAMING")),
        F.when(fails(fidelity_holds), F.lit("VISIBLE_FIDELITY_LIMIT_EXCEEDED")),
    ))
    return geometry.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def counterfactuals(outputs: DataFrame, spark: SparkSession, signal: Signal, source: str = "source_text", output: str = "output_text", keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """What given outputs leave of their sources' windows: survival and distances, one row an output.

    Every distinct (source, output) is tokenised, aligned and masked once, however many rows share it.
    Ambiguous tokens are told apart.  It measures outputs that are there; it makes none.
    """
    one = F.sha2(F.concat_ws("|", F.sha2(source, 256), F.sha2(output, 256)), 256)
    rows = outputs.withColumn("core_", one)
    cores = rows.groupBy("core_").agg(F.first(source).alias("s_"), F.first(output).alias("o_"))
    texts = cores.select("core_", F.levenshtein("s_", "o_").alias("char_distance"), F.explode(F.array(F.struct(tokens(F.col("s_")).alias("a"), tokens(F.col("o_")).alias("b")))).alias("t"))
    pairs = with_ambiguity(aligned(texts.select("core_", "char_distance", "t.*")))
    # Behind a table: windows of both sides and the alignment would each make it again.
    pairs = keep_table(pairs)
    root, final = (signal_windows(pairs, spark, signal, tokens=c, doc="core_") for c in ("a", "b"))
    told = survival(window_diffs(pairs, signal.n, ("core_",)), root, final, ("core_",))
    facts = pairs.select("core_", "char_distance", F.col("al.distance").alias("token_distance"), F.size("a").alias("tokens"))
    whole = facts.join(told, "core_", "left")
    empty = {c: 0 for c in ("eligible", "survived", "newly_masked", "unmapped", "changed", "ambiguous")}
    whole = whole.fillna(empty | {"ratio": 1.0, "destroyed_ratio": 0.0, "status": "NO_ELIGIBLE_OBSERVATIONS"})
    return rows.select(*keep, "core_").join(whole, "core_").drop("core_")


def bit_drift(diffs: DataFrame, root: DataFrame, final: DataFrame, keep: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(keep, depth, compared, changed): bits that differ over mapped windows valid on both sides."""
    old = root.where("valid").select(*keep, "pos", F.col("g").alias("g0"))
    new = final.where("valid").select(*keep, F.col("pos").alias("to"), F.col("g").alias("g1"))
    both = diffs.where("to IS NOT NULL").join(old, [*keep, "pos"]).join(new, [*keep, "to"])
    each = both.select(*keep, F.posexplode(F.zip_with("g0", "g1", lambda x, y: (x != y).cast("int"))).alias("depth", "changed"))
    return each.groupBy(*keep, "depth").agg(F.count("*").alias("compared"), F.sum("changed").alias("changed"))


def leverage(gain: Column, cost: Column) -> Column:
    """Gain for each unit of cost; null where there is no cost."""
    return F.when(cost > 0, gain / cost)


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance on characters."""
    return F.levenshtein(a, b)


def edit_rate(distance: Column, size: Column) -> Column:
    """min(1, distance / size); without any size 0 or 1."""
    return F.when(size > 0, F.least(F.lit(1.0), distance / size)).otherwise((distance > 0).cast("double"))
