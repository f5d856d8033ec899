"""Personal data: base matchers, and bootstrapped contextual extraction on top of them.

What the base matchers find seeds the search.  An occurrence lies on up to three lexical patterns: the two
words before it, the two words behind it, and its own shape (digits and letters generalised).  Spark
scores the graph of patterns and instances in turns: a pattern by the share of its instances that are
trusted, an instance by a noisy-or over its patterns.  Identifier-like text that the base matchers
leave out (looser shapes, and parts of runs that are dropped as a whole because another number follows) is
reported as well where it lies on a pattern of high confidence.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, spare
from .words import text_slices, with_text

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
#: Only texts in which this is found can hold anything.
HINT = r"[0-9@]|[(\[]at[)\]]| dot "
_RUN = re.compile(r"[+(]?[0-9][0-9() .-]*")
_PIECE = re.compile(r"[+(]?[0-9][0-9().-]*")
_SPELT = re.compile(r"([A-Za-z0-9._%+-]+) at ([A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")
_COLONS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")

SPAN = "array<struct<kind:int,start:int,end:int,seed:boolean,patterns:array<string>,instance:string>>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each @ is looked at once, so long texts take linear time."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", m.end() if m else at + 1)


def addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(t):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(t: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    return sorted((s, k, e) for k, find in enumerate((emails, addresses, cards, phones)) for s, e in find(t))


def _inside(t: str, at: int, run: str) -> Iterator[tuple[int, int, int]]:
    """Cards and phones that are some of the pieces of a run of digits and separators, each start with few ends."""
    pieces = [(m.start(), m.end(), sum(c.isdigit() for c in m[0])) for m in _PIECE.finditer(run)]
    for k, (a, _, _) in enumerate(pieces):
        digits = 0
        for i, (_, b, n) in enumerate(pieces[k:], k):
            digits += n
            if digits > 19:
                break
            s = run[a:b].rstrip(" .-(")
            if s.startswith("(") and ")" not in s:
                s = s[1:]
                a += 1
            plain = s.replace(" ", "").replace("-", "")
            if 12 <= digits and plain.isdigit() and (i == k or _luhn(plain)):
                yield at + a, 2, at + a + len(s)
            elif 7 <= digits <= 15 and len(s) > digits and s.count("(") == s.count(")") <= 1 and s.count(".") < 3:
                yield at + a, 3, at + a + len(s)


def loose_spans(t: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of text with a wider shape of some kind; these may overlap."""
    for m in _WORD.finditer(t):
        w = m[0]
        if "@" in w or "(at)" in w or "[at]" in w:
            s = w.strip(".,;:!?\"'<>")
            a, _, b = s.replace("(at)", "@").replace("[at]", "@").partition("@")
            if a and b and "@" not in b:
                at = m.start() + w.index(s)
                yield at, 0, at + len(s)
        elif w.count(":") >= 2 or w.count("-") == 3:
            s = w.strip(".,;!?()\"'")
            four = s.split("-")
            if _COLONS.fullmatch(s) and any(c.isdigit() for c in s) or len(four) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in four):
                at = m.start() + w.index(s)
                yield at, 1, at + len(s)
    for m in _SPELT.finditer(t):
        yield m.start(), 0, m.end()
    for m in _RUN.finditer(t):
        yield from _inside(t, m.start(), m[0])


def shape(kind: int, value: str) -> str:
    """Digits as 9 and runs of letters as a; a card's tells whether its check digit is right."""
    told = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", value))
    return told + (" checked" if kind == 2 and _luhn(value.replace(" ", "").replace("-", "")) else "")


def _patterns(t: str, words: list[tuple[int, int]], starts: list[int], kind: int, start: int, end: int) -> list[str]:
    """The lexical patterns that an occurrence lies on: whole words before and behind, lower case, and its shape."""
    at, behind = bisect.bisect_left(starts, start), bisect.bisect_left(starts, end)
    # A word that the occurrence begins or ends in counts with what it has outside.
    before = [t[a : min(b, start)].lower() for a, b in words[max(0, at - 2) : at]]
    after = [t[a:b].lower() for a, b in words[behind : behind + 2]]
    out = [f"shape {shape(kind, t[start:end])}"]
    if len(before) == 2:
        out.append(f"after {' '.join(before)}")
    if len(after) == 2:
        out.append(f"before {' '.join(after)}")
    return out


def found(t: str) -> list[dict]:
    base = base_spans(t)
    out = [(s, k, e, True) for s, k, e in base]
    starts, ends = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for s, k, e in sorted(set(loose_spans(t))):
        # Base spans that begin before its end: the furthest of their ends tells whether one overlaps.
        at = bisect.bisect_left(starts, e)
        if not at or ends[at - 1] <= s:
            out.append((s, k, e, False))
    if not out:
        return []
    words = [m.span() for m in _WORD.finditer(t)]
    firsts = [a for a, _ in words]
    keys = ("kind", "start", "end", "seed", "patterns", "instance")
    return [dict(zip(keys, (k, s, e, seed, _patterns(t, words, firsts, k, s, e), t[s:e].lower()), strict=True)) for s, k, e, seed in sorted(out)]


def occurrences(df: DataFrame, text: str, keep: tuple[str, ...], into: str) -> DataFrame:
    """Every row with its base matches and looser candidates, each with its patterns."""
    span = T._parse_datatype_string(SPAN)
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, span)])
    sent, at = with_text(df, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(span)
        for b, texts in text_slices(batches, at):
            worth = pc.match_substring_regex(texts, HINT).to_pylist()
            lists = pa.array([found(t.as_py()) if w else [] for t, w in zip(texts, worth, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=out.names)

    return arrow_map(sent, run, out)


def confident_patterns(seen: DataFrame, scratch: Scratch, rounds: int, least: float, support: int) -> DataFrame:
    """(kind, pattern, conf) of the patterns that pass after some rounds over the graph.

    ``seen`` has kind, patterns, instance and seed of every occurrence.  Edges are pre-aggregated, so
    what is joined is distinct pattern-instance pairs.  A pattern's confidence is its instances' trust, summed
    over those of the kind and divided by one more than all its instances of any kind.
    """
    each = seen.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = scratch.keep(each.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")))
    trust = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("conf"))
    of_all = scratch.keep(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    patterns = None
    for _ in range(rounds):
        hits = edges.join(trust, ["kind", "instance"]).groupBy("kind", "pattern")
        patterns = scratch.keep(
            hits.agg(F.sum("conf").alias("good"), F.sum((F.col("conf") >= 0.5).cast("long")).alias("support"))
            .join(of_all, "pattern")
            .select("kind", "pattern", (F.col("good") / (F.col("n") + 1)).alias("conf"), "support")
            .where((F.col("conf") >= least) & (F.col("support") >= support))
        )
        belief = edges.join(patterns.select("kind", "pattern", "conf"), ["kind", "pattern"], "left").groupBy("kind", "instance")
        doubt = F.sum(F.log(F.greatest(1 - F.coalesce("conf", F.lit(0.0)), F.lit(1e-9))))
        trust = belief.agg(F.max("seed").alias("seed"), (1 - F.exp(doubt)).alias("c"))
        trust = trust.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("c")).alias("conf"))
    return patterns


def extract(
    df: DataFrame,
    spark: SparkSession,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    rounds: int = 3,
    least: float = 0.7,
    support: int = 3,
) -> DataFrame:
    """The columns ``keep``, ``base`` and ``spans``: arrays of (start, kind, end), sorted.

    ``base`` holds the matches of the four base matchers in the whole text, ``spans`` these and what
    patterns of at least ``least`` confidence and ``support`` trusted instances discovered; of
    discoveries that overlap, the one of the most confident pattern stays, then the longest, then the
    first.  Kinds are numbered as in KINDS; positions are code points, ends exclusive.  A null or empty
    text has none; repeated rows get equal results; an empty table gives no rows; other columns are
    ignored, and kept ones named base or spans are replaced.
    """
    scratch = Scratch(spark)
    keep = tuple(c for c in keep if c not in ("base", "spans"))
    row, found_, new_ = (spare(f"▁{c}", keep) for c in ("row", "found", "new"))
    rows = scratch.keep(occurrences(df, text, keep, found_).withColumn(row, F.monotonically_increasing_id()))
    seen = rows.select(F.col(row).alias("row"), F.explode(found_).alias("f")).select("row", "f.*")
    patterns = confident_patterns(seen, scratch, rounds, least, support)
    new = seen.where("NOT seed").select("row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(patterns.select("kind", "pattern", "conf"), ["kind", "pattern"])
    # Best first: by confidence, length and place.
    best = F.struct((-F.max("conf")).alias("conf"), (F.col("start") - F.col("end")).alias("size"), "start", "kind", "end")
    new = new.groupBy("row", "start", "kind", "end").agg(best.alias("best")).groupBy("row").agg(F.array_sort(F.collect_list("best")).alias("new"))
    span = "array<struct<start:int,kind:int,end:int>>"
    clear = lambda x, taken: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    as_span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    added = F.aggregate("new", F.array().cast(span), lambda taken, x: F.when(clear(x, taken), F.array_append(taken, as_span(x))).otherwise(taken))
    base = F.transform(F.filter(found_, lambda f: f["seed"]), as_span).cast(span)
    both = rows.join(new.select(F.col("row").alias(row), added.alias(new_)), row, "left")
    spans = F.array_sort(F.concat(base, F.coalesce(new_, F.array().cast(span))))
    return both.select(*keep, base.alias("base"), spans.alias("spans"))
