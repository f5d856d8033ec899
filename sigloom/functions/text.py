"""Text to words, token numbers and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case words: runs of characters other than space and U+0009 to U+000D; none for null."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.filter(split, lambda w: w != "")


def token(word: Column) -> Column:
    """A stand-in tokenizer: 28 bits of a word's MD5 as its number."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    return F.transform(words(text), token)


def content_words(text: Column) -> Column:
    """ASCII words with one inner apostrophe part, as they stand in the text."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?)"), 1)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def seed64(payload: Column) -> Column:
    """Low 64 bits of a payload's SHA-256, unsigned."""
    return F.conv(F.right(F.sha2(payload, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")


def seed_payload(master: int, *parts: Column) -> Column:
    """Canonical JSON of a master seed and text parts: the payload that seeds are derived from."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.concat(F.lit(f'{{"master_seed":{master},"parts":['), F.concat_ws(",", *quoted), F.lit("]}"))


def shard(master: int, shards: int, sample_id: Column) -> Column:
    """A sample's shard number, by its derived seed."""
    return (seed64(seed_payload(master, F.lit("shard"), sample_id)) % F.lit(shards)).cast("int")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def is_sha256(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")
