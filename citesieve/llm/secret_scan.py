"""Secret scan: key patterns, and sliding-window Shannon entropy per character class with an allow-list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns and the least length of what they find.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = ("passw", "secret", "token", "api")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
#: Character classes of the entropy scan, narrowest first: name, characters of a candidate, window, least bits per character in a window.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.2),
    ("base32", re.compile(r"[A-Z2-7]{20,}"), 20, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9),
)
#: Candidates that are not secrets although they look random: public identifiers, digests, paths, numbers, words in lower case, with capitals at their start, or in capitals and joined.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:sha\d+|md5)-[A-Za-z0-9+/=]+",
    r"[a-z]*(?:[A-Z][a-z]{2,})*(?:[-_/][a-z]*(?:[A-Z][a-z]{2,})*)*",
    r"[A-Z]{1,15}(?:[-_/][A-Z]{1,15})+",
    r"[0-9]+(?:[-_/][0-9]+)*",
    r"[=_/+-]+.{0,3}[=_/+-]*",
)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def entropy_runs(candidate: str, window: int, bits: float) -> list[tuple[int, int]]:
    """The parts of a candidate covered by windows of at least ``bits`` bits per character.

    Shannon entropy of a window is log2(w) - sum(c * log2(c)) / w over its character counts c; the
    sum is kept up to date as one character enters and one leaves.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = math.log2(window)
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n] if n < window else 0.0
        if i >= window:
            gone = candidate[i - window]
            m = counts[gone]
            counts[gone] = m - 1
            total += term[m - 1] - term[m]
        if i >= window - 1 and most - total / window >= bits - 1e-9:
            low = i - window + 1
            if runs and low <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((low, i + 1))
    return runs


class Scanner:
    def __init__(self, classes=CLASSES, allowed=ALLOWED):
        self.assign, self.access = re.compile(ASSIGN), re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
        self.classes, self.allowed = classes, re.compile("|".join(f"(?:{a})" for a in allowed)) if allowed else None
        self.any = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(c[2] for c in classes)) if classes else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        low = text.lower() if len(text) < 1 << 16 or text.isascii() else None
        if low is None or any(h in low for h in ASSIGN_HINT):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
        return found + [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]

    def entropy(self, text: str) -> list[tuple[int, int]]:
        """Spans of high entropy: the narrowest class that a candidate fits decides its threshold; allowed candidates are left out."""
        spans = []
        for m in self.any.finditer(text) if self.any else ():
            if self.allowed and self.allowed.fullmatch(m[0]):
                continue
            for _, pattern, window, bits in self.classes:
                if pattern.fullmatch(m[0]):
                    spans += [(m.start() + a, m.start() + b) for a, b in entropy_runs(m[0], window, bits)]
                    break
        return spans

    def scan(self, text: str) -> list[dict]:
        """All spans by start, then kind. Entropy spans inside a base span add nothing and are left out."""
        base = sorted(self.base(text))
        more, at, reach = [], 0, 0
        for a, b in self.entropy(text):  # by start: the base spans that begin before one reach as far as the farthest of them
            while at < len(base) and base[at][0] <= a:
                reach = max(reach, base[at][2])
                at += 1
            if b > reach:
                more.append((a, 3, b))
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + more)]


def scan_secrets(df: DataFrame, text: str = "text", spans: str = "spans", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end) in code points, end exclusive, over the whole of each text.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns, leftmost and non-overlapping per
    kind; ``entropy`` marks runs of random characters that they leave. Null counts as empty and has
    no spans; repeated rows get the same spans; an empty table stays empty; a column already named
    ``spans`` is replaced and all others are kept. Each row is scanned by itself in one pass.
    """
    rest = df.drop(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(classes, allowed).scan
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = pa.array([scan(t.as_py() or "") for t in batch.column(text)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, spans])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(spans, SPANS)]))


def digests(scanned: DataFrame) -> DataFrame:
    """The counts and digest columns of rows that ``scan_secrets`` made."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
