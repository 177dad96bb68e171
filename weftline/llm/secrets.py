"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are runs of 20 or more characters of keys and tokens.  Each is cut into runs of letters, digits and the
base64 signs, of one class (hexadecimal, one case with digits, both cases with digits, or with signs), over which, and
over its pieces without signs, a window of 20 characters slides; its Shannon entropy follows from counts that change
by one character in and one out.  Windows at or above the class's threshold are merged into a span.  Spans are
suppressed by an allow list: paths, addresses and identifiers of plain names, versions and dates, UUIDs, words joined
by signs, strings without both letters and digits, and any that touch a span of the patterns.

Cases: null or empty text has no span.  Repeated rows are scanned each; a null doc_id is kept.  Very long texts are
scanned whole, and a candidate of any length in one pass.  An empty table gives an empty result.  Other columns are
not read by `scan_secrets`, and are passed on by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import batch_of, small_batches, texts

# Fixed patterns: kind, expression, group that has the length, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits of a window, by class; of random strings of the class's alphabet, 1 to 2 % of the windows are below (hex: 3 %).
BITS = {"hex": 3.0, "lower": 3.4, "upper": 3.35, "mixed": 3.65, "base64": 3.65}
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{WINDOW},}}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_PIECE = re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}")
_HEXRUN = re.compile(r"[0-9a-fA-F]+")
_ALLOW = re.compile(
    r"""[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}  # UUID
    | (?:[A-Za-z]{2,}[-_./=+])+[A-Za-z]*                    # words joined by signs
    | [0-9.+/_=-]+ | [A-Za-z]+ | (?P<sign>.)(?P=sign)*                     # numbers, dates; one word; one sign
    """,
    re.X,
)
#: Words, names in mixed case, numbers and versions: what the names in paths and identifiers are made of.
_PLAIN = re.compile(r"[A-Z]?[a-z]*[0-9]{0,4} | [A-Z]+[0-9]{0,4} | [0-9]+[a-z]{0,4} | [a-z]{1,3}[0-9]{1,3}[a-z]{1,4} | [a-z]*(?:[A-Z][a-z]+)+[0-9]{0,4}", re.X)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_LOG = [0.0, 0.0, *(n * math.log2(n) for n in range(2, WINDOW + 2))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of kind, end) of the pattern matches."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def windows(s: str, bits: float, size: int = WINDOW) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of s whose entropy is at least bits."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= size:
            n = counts[g := s[i - size]]
            total += _LOG[n - 1] - _LOG[n]
            counts[g] = n - 1
        if i >= size - 1 and math.log2(size) - total / size >= bits - 1e-9:
            a = i - size + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def allowed(s: str) -> bool:
    """On the allow list, or made of plain names, as paths and identifiers are; base64 holds slashes too, but not plain names."""
    return bool(_ALLOW.fullmatch(s)) or all(map(_PLAIN.fullmatch, re.split("[/._=+-]+", s)))


def kind_of(s: str) -> str:
    """The class of characters of a run."""
    if _HEXRUN.fullmatch(s):
        return "hex"
    if not s.isalnum():
        return "base64"
    return "lower" if s == s.lower() else "upper" if s == s.upper() else "mixed"


def high(s: str) -> list[tuple[int, int]]:
    """Merged windows of high entropy for the class of s, unless it is allowed or holds no letter or no digit."""
    if len(s) < WINDOW or allowed(s) or not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
        return []
    return windows(s, BITS[kind_of(s)])


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        if allowed(m[0].strip(".")):
            continue
        for r in _RUN.finditer(m[0]):
            if allowed(r[0]):
                continue
            at, end = m.start() + r.start(), -1
            pieces = [p for p in _PIECE.finditer(r[0]) if p[0] != r[0]]
            for a, b in sorted([*high(r[0]), *((p.start() + a, p.start() + b) for p in pieces for a, b in high(p[0]))]):
                if a <= end:
                    a = out.pop()[0] - at
                end = max(b, end)
                out.append((at + a, 3, at + end))
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each ordered by start, then kind."""
    base = sorted(base_spans(text))
    more, at, reach = [], 0, 0
    for s in entropy_spans(text):  # ordered and apart; reach is the last end of the base spans that begin before s ends
        while at < len(base) and base[at][0] < s[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s[0]:
            more.append(s)
    return base, sorted(base + more)


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for t in texts(b):
                base, every = spans(t)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            yield batch_of(_OUT, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 5))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with each merged span replaced by the mark."""
    _, found = spans(text)
    out, at = [], 0
    for a, _, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if found else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, if there is one of a number's type, as long as the new text."""
    small_batches(docs.sparkSession)
    count = next((f.name for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)

    def run(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [t if t is None else redacted(t) for t in old]
            at = b.schema.get_field_index("text")
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if count:
                at = b.schema.get_field_index(count)
                was = b.column(at).to_pylist()
                b = b.set_column(at, b.schema.field(at), pa.array([w if o == n else len(n) for w, o, n in zip(was, old, new, strict=True)], b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
