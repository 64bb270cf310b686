"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more token characters. Assignment signs, UUIDs and placeholders that stand alone are cut out of
it; inside of a run of letters and digits nothing is cut. In what is left, every run of one character class (hexadecimal, small letters and digits, capitals and digits, base64) is
walked with a window whose character counts, and with them the sum of ``c * log2(c)``, change by one character in and one
out; windows that reach the class's threshold are joined into spans, which end where the letters and digits end. An
allow-list then drops the spans that are no secrets themselves: words without digits, numbers, placeholders, paths and names of
words and numbers. What stands beside a span never suppresses it. Spans of the fixed patterns are never dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import tidily

# The patterns, lengths and their order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is found from its first character

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Class name: (runs of its characters, window, least entropy in bits of a window).
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]+"), 20, 3.0),
    "lower": (re.compile(r"[a-z0-9]+"), 20, 3.6),
    "upper": (re.compile(r"[A-Z0-9]+"), 20, 3.6),
    "base64": (re.compile(r"[A-Za-z0-9+/_-]+"), 20, 3.9),
    "encoded": (re.compile(r"eyJ[A-Za-z0-9_-]+"), 20, 3.2),  # an encoded object, as tokens in three parts begin with
}
# Placeholders, and what is cut out of a candidate.
PLACEHOLDER = r"(?:example|sample|placeholder|dummy|changeme|your|x{4,}+|0{4,}+|1234567[0-9]*+)"
CUTS = re.compile(rf"=+|(?<![0-9a-fA-F])[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}(?![0-9a-fA-F])|(?<![A-Za-z0-9]){PLACEHOLDER}(?![A-Za-z0-9])", re.I)
ALLOWED = (
    re.compile(r"[^0-9]*"),
    re.compile(r"[0-9+/_=-]*"),
    re.compile(rf"(?:{PLACEHOLDER}|(?:key|secret|token|password)|[+/_=-])*", re.I),
    re.compile(r"(?=.*[/_-])[/_-]*([a-z]+|[A-Z][a-z]*|[0-9]{1,4})([/_-]+([a-z]+|[A-Z][a-z]*|[0-9]{1,4}))*[/_-]*"),
    re.compile(r"([A-Z]?[a-z]{2,}[0-9]{1,4}[/_-]*)+([A-Z]?[a-z]*)|([A-Z]{3,}[0-9]{1,4}[/_-]*)+[A-Z]*"),
)
ALNUM = re.compile(r"[A-Za-z0-9]+")
_GAIN = [0.0, 0.0] + [c * math.log2(c) for c in range(2, 257)]


def entropy_spans(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is ``least`` bits or more; each step changes two counts."""
    if len(run) < window:
        return []
    counts: dict[str, int] = {}
    total, most = 0.0, window * (math.log2(window) - least) + 1e-9  # H >= least  <=>  sum of c*log2(c) <= most
    out: list[list[int]] = []
    for i, x in enumerate(run):
        c = counts.get(x, 0)
        total += _GAIN[c + 1] - _GAIN[c]
        counts[x] = c + 1
        if i >= window:
            y = run[i - window]
            c = counts[y]
            total += _GAIN[c - 1] - _GAIN[c]
            counts[y] = c - 1
        if i >= window - 1 and total <= most:
            begin = i - window + 1
            if out and begin <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([begin, i + 1])
    return [(a, b) for a, b in out]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def pieces(candidate: str) -> list[tuple[int, int]]:
    """Stretches of a candidate between what is cut out of it."""
    out, at = [], 0
    for m in CUTS.finditer(candidate):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(candidate)))
    return out


def allowed(span: str) -> bool:
    return any(x.fullmatch(span) for x in ALLOWED)


def widened(piece: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, each out to where the letters and digits at its ends end; equal ones once."""
    if not spans:
        return []
    words = [m.span() for m in ALNUM.finditer(piece)]
    starts = [a for a, _ in words]
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if a and piece[a - 1].isalnum():
            a = words[bisect_right(starts, a - 1) - 1][0]
        if b < len(piece) and piece[b].isalnum():
            b = words[bisect_right(starts, b) - 1][1]
        if not out or out[-1] != (a, b):
            out.append((a, b))
    return out


def method_spans(text: str) -> list[tuple[str, int, int]]:
    """Entropy spans that no allow-list entry covers; overlapping ones of the classes are joined."""
    found: list[tuple[int, int]] = []
    for candidate in CANDIDATE.finditer(text):
        for begin, end in pieces(candidate.group()):
            piece = candidate.group()[begin:end]
            for runs, window, least in CLASSES.values() if not allowed(piece) else ():
                for run in runs.finditer(piece):
                    spans = [(a + run.start(), b + run.start()) for a, b in entropy_spans(run.group(), window, least)]
                    found += [(candidate.start() + begin + a, candidate.start() + begin + b) for a, b in widened(piece, spans) if not allowed(piece[a:b])]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [("entropy", a, b) for a, b in joined]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans) -> str:
    """The text with every covered stretch replaced by one mark that names the first kind there."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """All spans of each row: doc_id, spans (array of kind, start, end, base), in code points, end exclusive.

    A null text is empty; a row without secrets has an empty array; repeated rows each have theirs. Sorted by start,
    then by kind in the order of ``KINDS``. Each row is scanned by itself and nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                both = [(*s, True) for s in base_spans(text)] + [(*s, False) for s in method_spans(text)]
                both.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in both])
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, SPANS)], names=["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidily(scan), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced by marks, and n_chars (where there is one) counted anew for changed texts.

    Every row stays, with all its columns; null texts stay null.
    """

    def one(text):
        if text is None:
            return None
        spans = base_spans(text) + method_spans(text)
        return redacted(text, spans) if spans else text

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidily(lambda all_: (texts.map(one) for texts in all_))(batches)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns, their digest, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(which: Column | str) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.base)
    number = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
