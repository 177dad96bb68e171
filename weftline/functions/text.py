"""Column functions on titles, bodies and answers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.config import Settings

S = Settings()


def as_bool(c: Column, kind: str) -> Column:
    """Truth of a column of any spelling: true/1/yes/t, a number other than 0; null is false."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(c.cast("int"), F.lit(0)) != 0
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "t"), F.lit(False))


def normalize_title(c: Column) -> Column:
    """Lower case without bracketed tags; letters and digits between single spaces."""
    # Patterns.
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_tokens(c: Column) -> Column:
    """The different words of a normalised title."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def word_tokens(c: Column) -> Column:
    """All runs of letters, digits and underscores of a lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of two sets; `empty` if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def is_duplicate_title(a: Column, b: Column, s: Settings = S) -> Column:
    """Near-equal normalised titles: enough words on both sides, and many in common or one inside the other."""
    ta, tb = title_tokens(a), title_tokens(b)
    enough = (F.size(ta) >= s.dup_min_tokens) & (F.size(tb) >= s.dup_min_tokens)
    inside = (F.length(a) >= s.dup_containment_chars) & (F.length(b) >= s.dup_containment_chars) & (F.contains(a, b) | F.contains(b, a))
    return enough & ((jaccard(ta, tb, 1.0) >= s.dup_jaccard) | inside)


def has_revert(c: Column, s: Settings = S) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike(s.revert)


def has_fix_word(normalised: Column, s: Settings = S) -> Column:
    return F.arrays_overlap(title_tokens(normalised), F.array(*map(F.lit, s.fix_words)))


def filename_tokens(c: Column) -> Column:
    """Words that look like file names or paths, without leading ./ and without outer / and dots; each once."""
    t = F.coalesce(c, F.lit(""))
    # Patterns.
    names = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_./-]*[A-Za-z0-9_-]\.[A-Za-z][A-Za-z0-9]{0,5})"), F.lit(1))
    paths = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)"), F.lit(1))
    bare = F.transform(F.concat(names, paths), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\./)+", ""), r"^[/.]+|[/.]+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.contains(x, F.lit(".")) | F.contains(x, F.lit("/"))))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def task_text(title: Column, body: Column) -> Column:
    return F.concat_ws(" || ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


def anon_id(version: str, seed: int, *key: Column) -> Column:
    """P and 16 hexadecimal digits that only the seed's owner can tie to the key."""
    return F.concat(F.lit("P"), F.substring(F.sha2(F.concat(F.lit(f"{version}:{seed}|"), F.concat_ws("|", *key)), 256), 1, 16))


def order_hash(seed, *key: Column) -> Column:
    """Deterministic random order, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def parse_judgement(c: Column, categories=("D", "C", "H", "B", "I", "none")) -> Column:
    """category, confidence (1 to 3), evidence (300 characters) of the JSON object in an answer; null if anything is off."""
    raw = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    j = F.from_json(raw, "category string, confidence string, evidence string")
    good = j["category"].isin(*categories) & j["confidence"].rlike(r"^[123]$")
    return F.when(good, F.struct(j["category"].alias("category"), j["confidence"].cast("int").alias("confidence"), F.substring(F.coalesce(j["evidence"], F.lit("")), 1, 300).alias("evidence")))


def parse_batch(c: Column, asked: Column | None = None) -> Column:
    """(id, prob in 0 to 1) of each item of a JSON array in an answer, or of loose `id: .. prob: ..` text; only the ids asked for, if given."""
    items = F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), "array<struct<id:int,prob:double>>")
    # Pattern.
    pattern = r'"?id"?\s*[:=]\s*(\d+)\D+?"?prob"?\s*[:=]\s*(\d+(?:\.\d+)?)'
    ids, probs = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    loose = F.transform(F.arrays_zip(ids.alias("i"), probs.alias("p")), lambda x: F.struct(x["i"].cast("int").alias("id"), x["p"].cast("double").alias("prob")))
    both = F.coalesce(F.when(F.size(items) > 0, items), loose)
    good = F.filter(both, lambda x: x["id"].isNotNull() & x["prob"].isNotNull() & (F.lit(True) if asked is None else F.array_contains(asked, x["id"])))
    return F.transform(good, lambda x: F.struct(x["id"].alias("id"), (F.least(F.greatest(x["prob"], F.lit(0.0)), F.lit(100.0)) / 100).alias("prob")))


def fenced_code(c: Column) -> Column:
    """Lines of the first fenced block; none: null, empty: an empty array."""
    # Pattern.
    fence = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"
    body = F.regexp_replace(F.regexp_extract(c, fence, 1), r"\n$", "")
    return F.when(c.rlike(fence), F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n")))


def pair_prompt(no: Column, task_a: Column, task_b: Column, chars: int = 900) -> Column:
    return F.format_string("### Pair %d\nA: %s\nB: %s\n", no, F.substring(task_a, 1, chars), F.substring(task_b, 1, chars))


def utc(c: Column) -> Column:
    """A timestamp from text; what is none is null."""
    return F.try_to_timestamp(c)


def listed(c: Column, sign: str = "|") -> Column:
    """The list that array_join(list, sign) wrote; empty text is the empty list."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, re.escape(sign)))


def json_object(*columns: str) -> Column:
    """A JSON object of some columns, in their order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
