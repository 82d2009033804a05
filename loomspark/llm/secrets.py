"""Secret scanning: fixed patterns plus sliding-window entropy.

Besides three fixed patterns, every candidate string (a run of token characters) is measured:
inside it each maximal run of one character class (hexadecimal, base 64) is crossed by a window
whose Shannon entropy is kept up to date from the counts of the character that enters and the one
that leaves.  A run whose best window reaches its class's threshold is reported, unless the
allow-list covers the candidate or base spans cover every character of it; a candidate that goes
on beyond them is reported whole, beside the spans inside it.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, pick

# The base patterns and their minimal lengths
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
WORDS = ("password", "passwd", "secret", "token", "api")

#: Class of characters: its window and the entropy in bits that its best window must reach.
CLASSES = {"hex": (r"[0-9A-Fa-f]+", 16, 2.9), "base64": (r"[A-Za-z0-9+/_-]+", 20, 3.7)}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Candidates that are no secrets: one kind of characters only, words joined by punctuation, UUIDs.
ALLOWED = (r"[A-Za-z+/_=-]+", r"[0-9+/_=-]+", r"(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[+/_=-]*",
           r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SPAN = "array<struct<kind: string, start: long, end: long, entropy: double>>"


def best_window(s: str, width: int) -> float:
    """The largest Shannon entropy, in bits, over all windows of ``width`` characters (0 if shorter)."""
    if len(s) < width:
        return 0.0
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    best = math.inf
    for i, ch in enumerate(s):
        if i >= width:  # first out, so that no count is ever above the width
            old = s[i - width]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width - 1 and total < best:
            best = total
    return math.log2(width) - best / width


def scanner(allow: Sequence[str] = ()):
    """Function from a text to its (kind, start, end, entropy) spans: base kinds first, each in order of start."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    access, hexa, cand = re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % MIN_HEX), re.compile(CANDIDATE)
    classes = [(re.compile(p), w, t) for p, w, t in CLASSES.values()]
    allowed = re.compile("|".join(f"(?:{p})" for p in (*ALLOWED, *allow)))
    digit = re.compile(r"[0-9]")

    def scan(text: str) -> list[tuple[str, int, int, float]]:
        out = []
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [("assign", m.start(), m.end(), 0.0) for m in assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in text:
            out += [("access", m.start(), m.end(), 0.0) for m in access.finditer(text)
                    if m.end() - m.start() >= MIN_ACCESS]
        if digit.search(text) is None:  # a secret by entropy holds a digit
            return out + [("hex", m.start(), m.end(), 0.0) for m in hexa.finditer(text)]
        out += [("hex", m.start(), m.end(), 0.0) for m in hexa.finditer(text)]
        starts, ends = [], []  # the characters that base spans cover, as runs
        for s, e in sorted((s, e) for _, s, e, _ in out):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        for m in cand.finditer(text):
            if digit.search(m[0]) is None or allowed.fullmatch(m[0]):
                continue
            at = bisect_right(starts, m.start()) - 1
            if at >= 0 and m.end() <= ends[at]:
                continue
            high = 0.0
            for runs, width, least in classes:
                for r in runs.finditer(m[0]):
                    got = best_window(r[0], width)
                    if got >= least and got > high:
                        high = got
            if high:
                out.append(("entropy", m.start(), m.end(), high))
        return out
    return scan


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 allow: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id`` and ``found``, the array of its spans (kind, start, end in code points,
    end exclusive, entropy).  Null counts as empty and has no spans; an empty table gives no rows; repeated rows
    are rows of their own; texts of any length are read whole.  Base spans of different kinds may overlap.
    ``allow`` adds regular expressions that suppress whole candidates of the entropy search."""
    src = pick(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = tuple(allow)

    def make():
        scan = scanner(extra)
        return lambda texts: [[[{"kind": k, "start": s, "end": e, "entropy": h} for k, s, e, h in scan(t)]
                               for t in texts]]
    return map_texts(src, make, f"found {SPAN}").withColumnRenamed("id", id_col)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then base kinds as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "entropy"))), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("a"), rank(s).alias("b"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("c"))))
    return F.array_join(F.transform(keyed, lambda s: s["c"]), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of ``find_secrets``."""
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select(
        id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        n("entropy").alias("n_entropy"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the same columns, every span of every text (overlaps merged) replaced by ``mark``.
    Null texts stay null; repeated rows and texts of any length come out row by row."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner()
        for batch in texts:
            out = []
            for t in batch:
                if t is None:
                    out.append(None)
                    continue
                parts, last = [], 0
                for s, e in sorted((s, e) for _, s, e, _ in scan(t)):
                    if s >= last:
                        parts += [t[last:s], mark]
                    last = max(last, e)
                out.append("".join(parts) + t[last:])
            yield pd.Series(out, dtype=object)
    return src.withColumn(names[at], mask(names[at])).toDF(*docs.columns)
