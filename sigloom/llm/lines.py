"""Fuzzy line deduplication with DataFrame functions only.

Two lines are near if their word sequences have an edit similarity of at least 0.8.  Lines with equal words are
one class from the start.  Of each class a similarity hash is made: seven blocks, the codes of those seven of its
pairs of neighbouring words that come first in an order common to all lines (that of a hash, but pairs of
short words, which many lines share, come last).  Near lines agree on two of the seven blocks: for certain up
to 14 words, as at most five may be others there, and nearly always beyond.  So each choice of two blocks is a
bucket key: the pigeonhole principle.  What shares a bucket is verified by edit similarity, and of each
connected group of equal or near lines the first occurrence stays.

Majority bits of words in place of these blocks lose most near lines: see the README for figures.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, Scratch, components, in_blocks, link_buckets, spare, union_all

#: Least edit similarity of the word sequences.
SIMILARITY = 0.8
#: Lines of fewer words always stay.
MIN_WORDS = 1
#: Blocks of a similarity hash, of which near lines agree on ``AGREE``.
BLOCKS, AGREE = 7, 2
#: Columns that hold the blocks, and the value that stands for none.
PACKS, NONE = (BLOCKS + 1) // 2, (1 << 31) - 1
#: Characters of a word that counts as short.
SHORT = 3
#: Characters that stand for words in edit distances: this many from U+4E00, in two texts by different bits.
_FIRST, CHARACTERS = 0x4E00, 20_000
#: Members of a bucket up to which all are compared with each other.
MANY = 128
#: Longs of the bits by which lines of a larger bucket are told apart, a power of two.
WIDE = 16
#: Slots in which words of lines in larger buckets are counted, or ends of pairs set bits, at least and at most, powers of two.
SLOTS = (1 << 16, 1 << 20)
#: Lines of larger buckets that a task splits into words.
DEALT = 512
#: Lines of a word that others meet first, and times as many that they meet next.
HUBS, RISE = 32, 16
#: Letters and digits of a lower-case line that is all ASCII.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"


def words(lowered: Column) -> Column:
    """A lower-case line's words: runs of letters and digits.

    A pattern is compiled for each line, and that of a plain list of characters compiles and matches fastest.
    """
    plain = F.octet_length(lowered) == F.length(lowered)
    return F.array_remove(F.when(plain, F.split(lowered, f"[^{_PLAIN}]+")).otherwise(F.split(lowered, r"[^\p{L}\p{N}]+")), "")


def _pairs(w: Column) -> Column:
    """Codes, of 31 bits, of each word with the one behind it and of the last word alone; those of two short words are the greatest."""

    def code(x: Column, y: Column) -> Column:
        both_short = (F.octet_length(x) <= SHORT) & (F.octet_length(y) <= SHORT)
        return F.hash(x, y).bitwiseAND(F.lit((1 << 30) - 1)).bitwiseOR(F.when(both_short, F.lit(1 << 30)).otherwise(F.lit(0)))

    return F.zip_with(w, F.slice(w, 2, F.size(w)), code)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, h1, h2, n, p0 .. p3) of every line: a digest of its words, their number, its blocks, two in each p.

    Of the functions of arrays only the codes of pairs need a lambda, which is interpreted; the others are compiled.
    """
    rows = docs.select("doc_id", "row", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line")).select("doc_id", "row", "pos", words(F.col("line")).alias("w"))
    sorted_ = F.when(F.size("w") >= 4, F.sort_array(_pairs(F.col("w"))))
    first = F.slice(F.array_distinct(F.slice(sorted_, 1, 2 * BLOCKS)), 1, BLOCKS)
    told = rows.select("doc_id", "row", "pos", F.xxhash64("w").alias("h1"), F.hash("w").alias("h2"), F.size("w").alias("n"), first.alias("first"))
    return told.select("doc_id", "row", "pos", "h1", "h2", "n", *(_packed(k).alias(f"p{k}") for k in range(PACKS)))


def _packed(k: int) -> Column:
    """Blocks 2 k and 2 k + 1 in a long: few columns make short code."""
    one, two = (F.coalesce(F.get("first", F.lit(i)).cast("long"), F.lit(NONE)) for i in (2 * k, 2 * k + 1))
    return F.shiftleft(one, 32).bitwiseOR(two)


def _block(i: int) -> Column:
    """Block i out of its pack, null where a line has fewer."""
    pack = F.col(f"p{i // 2}")
    part = F.shiftright(pack, 32) if i % 2 == 0 else pack.bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(part != NONE, part)


def bucket_keys() -> Column:
    """A key for each choice of two blocks; a line of fewer blocks, which repeats its words, takes each alone as well.

    Keys of blocks that a line hasn't got are null.
    """
    both = lambda i, j: F.shiftleft(F.col(f"c{i}"), 31).bitwiseOR(F.col(f"c{j}"))
    some = [both(i, j) for i, j in itertools.combinations(range(BLOCKS), AGREE)]
    few = F.col(f"c{BLOCKS - 1}").isNull() & (F.col("n") >= BLOCKS) | F.col("c3").isNull()
    alone = [both(k, k) for k in range(BLOCKS - 1)]
    return F.when(few, F.array(*some, *alone)).otherwise(F.array(*some))


def _most(a: Column, b: Column, similarity: float) -> Column:
    """Edits that lines of so many words may be apart."""
    return F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9).cast("int")


#: Columns by which lines are told to be far apart before their texts meet.
TRAITS = ("n", "b0", "b1")


def _traits(c: Column) -> list[Column]:
    """What the comparison of two lines needs: two texts of a character a word, from different bits of the words' numbers,
    how many words there are, and 128 bits of which each word sets one."""
    nought = F.lit(0).cast("long")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    half = lambda k: F.aggregate(c, nought, lambda acc, x: F.when(x.bitwiseAND(F.lit(64)) == k, acc.bitwiseOR(bit(x))).otherwise(acc))
    text = lambda by: F.decode(F.unhex(F.array_join(F.transform(c, lambda x: F.hex(F.shiftrightunsigned(x, by) % CHARACTERS + _FIRST)), "")), "UTF-16BE")
    return [F.size(c).alias("n"), half(0).alias("b0"), half(64).alias("b1"), text(8).alias("codes"), text(32).alias("more")]


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether numbers of words, and the bits that these set, are near enough: an edit takes one word and brings another."""
    most = _most(F.col(f"{a}n"), F.col(f"{b}n"), similarity)
    changed = sum(F.bit_count(F.col(f"{a}{h}").bitwiseXOR(F.col(f"{b}{h}"))) for h in ("b0", "b1"))
    return (F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= most) & (changed <= 2 * most)


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether lines are near.  Different words may share a character in one text, which can only lower a distance, but hardly in both."""
    most = _most(F.col(f"{a}n"), F.col(f"{b}n"), similarity)
    far = lambda c: F.call_function("levenshtein", F.col(f"{a}{c}"), F.col(f"{b}{c}"), most) >= 0
    return far("codes") & far("more")


def _gathered(values: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """One row with an array of ``n`` longs: by slot, the values of (slot, value), nought where there is none."""
    none = scratch.spark.range(n).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("value"))
    every = values.unionByName(none).groupBy("slot").agg(F.sum("value").alias("value"))
    return scratch.keep(every.agg(F.sort_array(F.collect_list(F.struct("slot", "value")))["value"].alias("all_")))


def _slot(x: Column, n: int) -> Column:
    """The slot of a hash, of ``n``, a power of two."""
    return F.shiftrightunsigned(x, 20).bitwiseAND(F.lit(n - 1)).cast("int")


def _bit(x: Column) -> Column:
    """A long with the one bit that a hash's last six tell."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def _asked(pairs: DataFrame, n_pairs: int, known: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines that are ends of pairs, and few others: those whose bit one of the ends sets.

    So texts of lines that no pair asks for aren't exchanged.  Bits are 64 to a slot; with more ends than these
    can tell apart other lines come along, which costs time but changes nothing.
    """
    n = min(max(SLOTS[0], 1 << (n_pairs // 4).bit_length()), SLOTS[1])
    ends = pairs.select(F.xxhash64("a").alias("h")).unionByName(pairs.select(F.xxhash64("b").alias("h")))
    bits = _gathered(ends.groupBy(_slot(F.col("h"), n).alias("slot")).agg(F.bit_or(_bit(F.col("h"))).alias("value")), n, scratch)
    h = F.xxhash64("rep")
    return known.where(F.get(bits.scalar(), _slot(h, n)).bitwiseAND(_bit(h)) != 0)


def _confirm(pairs: DataFrame, known: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of lines that are near."""
    pairs = scratch.keep(pairs.select("a", "b"))
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    known = _asked(pairs, n_pairs, known, scratch)
    x, y = (known.select(F.col("rep").alias(c), *(F.col(f).alias(f"{c}_{f}") for f in ("n", "codes", "more"))) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(_near("a_", "b_", similarity)).select("a", "b")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The rows (key, rep) of buckets of several members; of the buckets with the same members, those of one.

    Lines that share many blocks meet in many buckets, most of which hold no other lines.  Equal members
    are told by their least, their number and the exclusive or of their hashes.  One exchange of ``keys`` serves
    the counts as well as the rows; no bucket is gathered.
    """
    dealt = keys.repartition("key")
    by = dealt.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n_members"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("n_members > 1")
    one = by.groupBy("least", "n_members", "mark").agg(F.min("key").alias("key")).select("key")
    return dealt.join(one.hint("shuffle_hash"), "key").select("key", "rep")


def _spread(told: DataFrame, known: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The lines with ``rare``, their rarest words, and w0 .., ``WIDE`` longs of bits of which each word sets one.

    An edit takes at most one word out of a line.  So of all words in one order, the first that two near lines
    share stands behind at most so many others in either as edits are allowed: lines that share none of
    that many words and one are far apart.  Ordered by how many lines have them, the words most lines share come last.
    Words are counted by slots of their numbers, so no word is looked up by a join: those of one slot count as
    often as all of them together, which changes the order but for all lines alike.  Words that no other line
    can have, the only ones of their slots, take their places but are left out.
    """
    number = F.array_distinct(F.zip_with(F.split("codes", ""), F.split("more", ""), lambda x, y: F.xxhash64(x, y)))
    sets = scratch.keep(told.select("rep").join(known.select("rep", "codes", "more"), "rep").select("rep", number.alias("words")))
    size = sets.count()
    # Each task gets as many lines, however many there are.
    words_ = sets.repartition(max(1, math.ceil(size / DEALT)), "rep").select("rep", F.explode("words").alias("word"))
    n_slots = min(max(SLOTS[0], 1 << size.bit_length()), SLOTS[1])
    slot = _slot(F.col("word"), n_slots)
    seen = _gathered(words_.groupBy(slot.alias("slot")).agg(F.count("*").alias("value")), n_slots, scratch)
    bit = _bit(F.col("word"))
    part = F.shiftright("word", 6).bitwiseAND(F.lit(WIDE - 1))
    bits = [F.bit_or(F.when(part == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WIDE)]
    counted = words_.select("rep", "word", F.get(seen.scalar(), slot).alias("seen"))
    by = counted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("seen", "word"))).alias("all_"), *bits)
    first = F.slice("all_", F.lit(1), _most(F.col("n"), F.col("n"), similarity) + 1)
    rare = F.filter(first, lambda x: x["seen"] > 1)["word"].alias("rare")
    out = scratch.keep(told.join(by, "rep").select(*told.columns, rare, *(f"w{k}" for k in range(WIDE))))
    scratch.drop(sets, seen)
    return out


def _between(side: DataFrame, known: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) of members of one bucket that lie in different components, which leave no near ones apart.

    Pairs of small buckets come by what is told without texts, after the large ones have joined components.
    """
    many = side.where(F.col("n_members") > MANY)
    links = None
    if many.limit(1).count():
        links, joined = _in_large(many, known, similarity, scratch)
        side = _moved(side, joined)
    few = side.where(F.col("n_members") <= MANY)
    x, y = (few.select("key", *(F.col(c).alias(f"{s}_{c}") for c in few.columns if c != "key")) for s in "xy")
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x_root") < F.col("y_root")) & _close("x_", "y_", similarity)).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
    found = _confirm(met.distinct(), known, similarity, scratch)
    return found if links is None else found.unionByName(links)


def _moved(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows whose components have been joined; ``joined`` has (node, root) of these."""
    further = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return rows.join(further, "root", "left").select(*(F.coalesce("to", "root").alias(c) if c == "root" else c for c in rows.columns))


def _in_large(side: DataFrame, known: DataFrame, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members of one large bucket, one for each two components, and (node, root) of the components joined.

    A line near to much of a component needs one link to it, not one to each of its members.  So lines first
    meet some of those with whom they share a rare word, ``HUBS`` of each word, and components are
    joined; then ``RISE`` times as many, while a word has so many lines.  A line near to more than a small part
    of those of a word has met one of these by then.  At last all meet that are still apart, so no link that
    joins two components is missed.
    """
    first = scratch.keep(side.groupBy("rep", "root", "n").agg(F.collect_list("key").alias("keys")))
    told, hubs, links = _spread(first, known, similarity, scratch), HUBS, []
    spots = scratch.keep(told.select("rep", "root", F.posexplode("rare").alias("place", "word")))
    while hubs:
        at, hubs = _shared_words(spots, hubs, scratch)
        pairs = _meet(told, at, similarity, hubs).distinct()
        root = lambda c: told.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        ends = _confirm(pairs, known, similarity, scratch).join(root("a"), "a").join(root("b"), "b")
        by = ends.groupBy(F.least("a_root", "b_root").alias("low"), F.greatest("a_root", "b_root").alias("high"))
        links.append(scratch.keep(by.agg(F.min(F.struct("a", "b")).alias("l")).select("l.a", "l.b", "low", "high")))
        hubs *= RISE
        if hubs and links[-1].limit(1).count():
            joined = components(links[-1], scratch, "low", "high")
            told, spots = scratch.keep(_moved(told, joined)), scratch.keep(_moved(spots, joined))
    found = union_all(links).select("a", "b")
    ends = [first.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    return found, components(found.join(ends[0], "a").join(ends[1], "b"), scratch, "a_root", "b_root")


def _shared_words(spots: DataFrame, hubs: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Those of ``spots``, (rep, root, place, word), whose words several components have, with largest, n_largest and n_all, and ``hubs``.

    Only words with more than ``RISE * hubs`` lines, and ``hubs`` of one component; where there are none, all of them, and 0.
    """
    sizes = spots.groupBy("word", "root").agg(F.count("*").alias("size")).groupBy("word")
    by = sizes.agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.max("size").alias("n_largest"), F.sum("size").alias("n_all"), F.count("*").alias("n_roots"))
    by = scratch.keep(by.where("n_roots > 1").drop("n_roots"))
    large = by.where((F.col("n_all") > hubs * RISE) & (F.col("n_largest") > hubs))
    if large.limit(1).count():
        return scratch.keep(spots.join(large, "word")), hubs
    return scratch.keep(spots.join(by, "word")), 0


def _meet(told: DataFrame, at: DataFrame, similarity: float, hubs: int) -> DataFrame:
    """The pairs (a, b) of lines of different components that share a rare word and a bucket and may be near.

    They aren't met bucket by bucket: lines meet where they share one of their rarest words, and each pair once,
    at the first of these.  A word's largest component meets the lines of others, but not itself.
    With ``hubs``, those of others meet only about so many lines of the word, by a hash.
    """
    each = ["n", "keys", "rare", *(f"w{k}" for k in range(WIDE))]

    def full(rows: DataFrame, prefix: str) -> DataFrame:
        all_ = rows.join(told.select("rep", *each), "rep")
        return all_.select(*(F.col(c).alias(f"{prefix}{c}") for c in all_.columns))

    most = _most(F.col("x_n"), F.col("y_n"), similarity)
    changed = sum(F.bit_count(F.col(f"x_w{k}").bitwiseXOR(F.col(f"y_w{k}"))) for k in range(WIDE))
    before = lambda c: F.slice(f"{c}_rare", F.lit(1), F.col(f"{c}_place"))
    # What the longer line has more is edits that bring a word and take none.
    more = F.abs(F.col("x_n") - F.col("y_n"))
    near = (more <= most) & (changed <= 2 * most - more) & F.arrays_overlap("x_keys", "y_keys") & ~F.arrays_overlap(before("x"), before("y"))

    def pairs(x: DataFrame, y: DataFrame, same: Column) -> DataFrame:
        return full(x, "x_").join(full(y, "y_"), same & near).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))

    def dealt(some: DataFrame, all_: DataFrame, n: Column) -> tuple[DataFrame, DataFrame]:
        cut = F.ceil(n / BLOCK)
        one = all_.select("word", "rep", "root", "place", F.pmod(F.xxhash64("rep"), cut).alias("i"))
        return some.select("word", "rep", "root", "place", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("i")), one

    same = lambda *by: functools.reduce(operator.and_, (F.col(f"x_{c}") == F.col(f"y_{c}") for c in by))
    some, rest = at.where("root = largest"), at.where("root <> largest")
    n_rest = F.col("n_all") - F.col("n_largest")
    if hubs:
        of_word = F.pmod(F.xxhash64("rep", F.lit(hubs)), F.col("n_all")) < hubs
        return pairs(*dealt(at.where(of_word), rest, n_rest), same("word", "i") & (F.col("x_root") != F.col("y_root")))
    others = in_blocks(rest.select("word", "rep", "root", "place", n_rest.alias("n_members")))
    apart = ((F.col("x_i") == F.col("x_j")) | (F.col("x_own") != F.col("y_own"))) & (F.col("x_root") < F.col("y_root"))
    return pairs(*dealt(rest, some, F.col("n_largest")), same("word", "i")).unionByName(pairs(others, others, same("word", "i", "j") & apart))


def repeated_lines(
    df: DataFrame,
    spark: SparkSession,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, row, pos, first_doc, first_pos) of the lines that repeat, and the occurrence that stays.

    The first is the least (doc_id, line number, row) of the connected group.  ``row`` is a digest of the
    whole text, which tells rows apart that repeat an id; rows with equal ids and texts count as one document.
    Lines of fewer than ``min_words`` words take no part, nor do null texts or rows with a null id.
    Lines with equal words repeat each other; lines of four words and fewer are never near otherwise.
    An empty table gives no rows.
    """
    # What only these steps read goes when they are done, so that it and the last exchange of texts aren't on disk at once.
    scratch, passing = scratch or Scratch(spark), Scratch(spark)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    every = scratch.keep(lines(docs))
    # One number that orders occurrences, so that sums by class need no sorting.
    place = F.shiftleft(F.col("pos").cast("long"), 31).bitwiseOR(F.col("row").bitwiseAND(F.lit((1 << 31) - 1)))
    told = every.where(F.col("n") >= min_words).withColumn("place", place).withColumn("spot", (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 62) + F.col("place")).cast("decimal(38,0)"))
    packs = [f"p{k}" for k in range(PACKS)]
    classes = told.groupBy("h1", "h2").agg(F.min("spot").alias("first"), F.count("*").alias("seen"), F.min_by("doc_id", "spot").alias("doc_id"), F.min_by("place", "spot").alias("place"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in packs])
    classes = passing.keep(classes.withColumn("rep", F.monotonically_increasing_id()))
    keys = classes.select("rep", "n", *(_block(i).alias(f"c{i}") for i in range(BLOCKS))).where("c0 IS NOT NULL").select("rep", F.explode(bucket_keys()).alias("key"))
    members = passing.keep(shared_buckets(keys.where("key IS NOT NULL")))
    # The words of these classes, from the rows that hold their first occurrence.
    low = (1 << 31) - 1
    where = [F.shiftright("place", 31).cast("int").alias("pos"), F.col("place").bitwiseAND(F.lit(low)).alias("low")]
    places = members.select("rep").distinct().join(classes.select("rep", "doc_id", *where), "rep")
    at = places.groupBy("doc_id", "low").agg(F.collect_list(F.struct("pos", "rep")).alias("at"))
    # Rows that are equal tell the same of each class.
    rows = docs.dropDuplicates(["doc_id", "row"]) if duplicates(every.where("pos = 0")) else docs
    rows = rows.withColumn("low", F.col("row").bitwiseAND(F.lit(low))).join(at.hint("shuffle_hash"), ["doc_id", "low"])
    line = lambda all_: F.transform("at", lambda a: F.struct(a["rep"].alias("rep"), F.element_at(all_, a["pos"] + 1).alias("line")))
    rows = rows.select(F.explode(F.transform(F.array(F.split(F.lower("text"), "\n")), line)[0]).alias("l")).select("l.rep", F.transform(words(F.col("l.line")), lambda x: F.xxhash64(x)).alias("c"))
    rows = rows.select("rep", *_traits(F.col("c")))
    known = passing.keep(rows)
    members = passing.keep(members.join(known.select("rep", *TRAITS), "rep"))
    roots = link_buckets(
        members,
        lambda pairs: _confirm(pairs, known, similarity, passing),
        lambda side: _between(side, known, similarity, passing),
        passing,
        traits=TRAITS,
        close=lambda a, b: _close(a, b, similarity),
    ).withColumnRenamed("node", "rep")
    # Of each group, the least occurrence over all its lines stays.
    grouped = classes.select("rep", "h1", "h2", "first", "doc_id", "place", "seen").join(roots, "rep", "left").where("seen > 1 OR root IS NOT NULL")
    grouped = scratch.keep(grouped.withColumn("root", F.coalesce("root", "rep")))
    passing.remove(passing.root)
    stays = grouped.groupBy("root").agg(F.min_by("doc_id", "first").alias("first_doc"), F.min_by("place", "first").alias("first_place"))
    fate = grouped.select("h1", "h2", "root").join(stays, "root").drop("root")
    gone = told.select("doc_id", "row", "pos", "h1", "h2", "place").join(fate, ["h1", "h2"]).where("doc_id <> first_doc OR place <> first_place")
    return gone.select("doc_id", "row", "pos", "first_doc", F.shiftright("first_place", 31).cast("int").alias("first_pos"))


def duplicates(docs: DataFrame) -> bool:
    """Whether a row (doc_id, row) occurs twice."""
    return bool(docs.groupBy("doc_id", "row").count().where("count > 1").limit(1).count())


def dedup_lines(
    df: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", into: tuple[str, str] = ("n_lines", "n_removed"), **options
) -> DataFrame:
    """The table with repeated lines cut from ``text``, and with n_lines and n_removed (long).

    Options are those of ``repeated_lines``.  A row with a null text or id comes back as it is, with 0
    removed; n_lines of a null text is 0.  ``into`` names the two counts; columns of these names are
    replaced.  Of rows that repeat an id each loses its own lines; equal rows are cut alike.
    """
    id_, row, gone_ = (spare(f"▁{c}", df.columns) for c in ("id", "row", "gone"))
    gone = repeated_lines(df, spark, doc_id, text, **options)
    gone = gone.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone_))
    # A lambda binds the split text: as an expression it would be split anew for every line.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    rest = lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.element_at(lines, i + 1)), "\n")
    kept = F.transform(F.array(F.split(text, "\n")), rest)[0]
    has = F.col(gone_).isNotNull()
    out = df.join(gone.hint("shuffle_hash"), (F.col(doc_id) == F.col(id_)) & (F.xxhash64(text) == F.col(row)), "left")
    counts = {
        into[0]: F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        into[1]: F.when(has, F.size(gone_)).otherwise(0).cast("long"),
        text: F.when(has, kept).otherwise(F.col(text)),
    }
    return out.withColumns(counts).drop(id_, row, gone_)
