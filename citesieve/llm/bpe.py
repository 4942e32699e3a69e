"""Byte-level BPE: encoding by a priority queue of merges over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that cuts a text into pieces before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose code a worker remembers before they become its older half; the half before that is forgotten.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids = data["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.of_byte = [ids[c] for c in byte_characters()]
        value = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {i: bytes(map(value.__getitem__, token)) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece. The queue holds (rank, place); an entry is stale when its left symbol is gone or the pair there has another rank."""
        ids = list(map(self.of_byte.__getitem__, piece.encode()))
        n, merges = len(ids), self.merges
        if n == 1:
            return (ids[0],)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (pair[0], i))
            h = before[i]
            if h >= 0 and (pair := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (pair[0], h))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, special = self.known, self.special
        for part in self.cut.split(text) if self.cut else [text]:
            if part in special:
                out.append(special[part])
                continue
            for piece in self.pieces.findall(part):
                ids = known.get(piece)
                if ids is None:
                    ids = self.older.get(piece) or self.merge(piece)
                    if len(known) >= REMEMBERED:
                        self.older, self.known = known, {}
                        known = self.known
                    if len(piece) <= 64:
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, concatenated; unknown ids give nothing, broken UTF-8 gives U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids if i in of]).decode("utf-8", "replace")


def public_vocabulary() -> str:
    """The vocabulary file that the registered queries use; every operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> Vocabulary:
    """The vocabulary of ``path``; a Python worker reads it once and keeps it for its later tasks."""
    kept = sys.__dict__.setdefault("_citesieve_vocabularies", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def _columns(batch: pa.RecordBatch, out: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in out]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(out.values()), names=names + list(out))


def _ids(texts: pa.Array, code) -> pa.ListArray:
    arrays = [np.array(code(t.as_py() or ""), dtype=np.int32) for t in texts]
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int32()))


def _texts(ids: pa.Array, decode_one) -> pa.Array:
    return pa.array([decode_one(() if not t.is_valid else t.values.to_numpy(zero_copy_only=False).tolist()) for t in ids], pa.string())


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` (array of int) for the whole of each text; it replaces a column of that name.

    Null counts as empty, and an empty text has no ids. Strings of special tokens in a text become
    those tokens. Rows are independent: ties, repeated rows and an empty table need no rule. Every
    row is encoded inside its task; a worker remembers the codes of up to twice ``REMEMBERED`` short pieces.
    """
    rest = df.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = load(vocabulary).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield _columns(part, {ids: _ids(part.column(text), code)})

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that each ``ids`` stands for. Null or empty ids give an empty text; unknown ids are left out."""
    rest = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_one = load(vocabulary).decode
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield _columns(part, {text: _texts(part.column(ids), decode_one)})

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with what :func:`encode` and then :func:`decode` give, in place of the text.

    One step of Python, not two: Spark runs both ends of a chain of Python steps at once, and each worker would hold the vocabulary and its pieces.
    """
    rest = df.drop(ids, decoded)
    fields = [f for f in rest.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = _ids(part.column(text), known.encode)
                yield _columns(part.drop_columns([text]), {ids: found, decoded: _texts(found, known.decode)})

    return rest.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows that ``encode`` and ``decode`` made."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
