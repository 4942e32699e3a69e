"""URL rules probed in a memory-mapped array of sorted digests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.llm.common import LOWER, UPPER

#: Bytes that a compiled rule list may have: it is configuration that every executor fetches once and maps, not data.
MAX_BYTES = 512 << 20
Rule = tuple[str, str, str]


class DigestArray:
    """Strings found by 64-bit digests: sorted keys in a mapped file, the strings beside them in another.

    ``find`` gives the position of each probe or -1. A position counts only if the stored string
    equals the probe; where strings share a digest, all that follow with it are tried.
    """

    def __init__(self, stem: str, digest=None):
        def mapped(part: str, kind) -> np.ndarray:
            path = f"{stem}.{part}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

        self.keys, self.ends, self.values, self.text = mapped("keys", np.uint64), mapped("ends", np.int64), mapped("values", np.int64), mapped("text", np.uint8)
        self.digest = digest or digest_of

    @staticmethod
    def write(stem: str, entries: Iterable[tuple[bytes, int]], digest=None) -> list[str]:
        made = sorted(((digest or digest_of)(s), s, v) for s, v in entries)
        parts = {"keys": np.array([k for k, _, _ in made], np.uint64), "ends": np.cumsum([0] + [len(s) for _, s, _ in made]).astype(np.int64),
                 "values": np.array([v for _, _, v in made], np.int64), "text": np.frombuffer(b"".join(s for _, s, _ in made), np.uint8)}
        for part, data in parts.items():
            data.tofile(f"{stem}.{part}")
        return [f"{stem}.{part}" for part in parts]

    def find(self, probes: list[bytes]) -> np.ndarray:
        keys = np.fromiter(map(self.digest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(probes), -1, np.int64)
        hits = np.flatnonzero(at < len(self.keys))
        hits = hits[self.keys[at[hits]] == keys[hits]]
        for i in hits.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.text[self.ends[j]:self.ends[j + 1]].tobytes() == probes[i]:
                    found[i] = self.values[j]
                    break
                j += 1
        return found


def digest_of(value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value)


def compile_rules(rules: Iterable[Rule], stem: str) -> list[str]:
    """Write rules (verdict, host, path) as digest arrays: hosts with the rules' path lengths, and whole rules with their verdict.

    A rule given with both verdicts blocks. Equal rules count once.
    """
    verdicts: dict[tuple[str, str], int] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"A rule blocks or allows, not {verdict!r}")
        if "/" in host or not (path == "" or path.startswith("/")):
            raise ValueError(f"A rule has a host and a path that is empty or starts with a slash, not {host!r}, {path!r}")
        at = (host.translate(str.maketrans(UPPER, LOWER)), path)
        verdicts[at] = max(verdicts.get(at, 0), int(verdict == "block"))
    lengths: dict[str, set[int]] = {}
    for host, path in verdicts:
        lengths.setdefault(host, set()).add(len(path))
    listed, starts = [], {}
    for host in lengths:
        starts[host] = len(listed)
        listed += [len(lengths[host]), *sorted(lengths[host], reverse=True)]
    np.array(listed, np.int64).tofile(f"{stem}.lengths")
    files = DigestArray.write(f"{stem}-hosts", ((h.encode(), starts[h]) for h in lengths))
    files += DigestArray.write(f"{stem}-rules", ((f"{h}\n{p}".encode(), v) for (h, p), v in verdicts.items()))
    return [f"{stem}.lengths", *files]


def ship_rules(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Compile ``rules``, check their size, and hand the files to Spark, from which every executor (a later one too) fetches its own copy. Returns their name."""
    name = f"urlrules-{uuid.uuid4().hex}"
    files = compile_rules(rules, os.path.join(tempfile.mkdtemp(prefix="spark-"), name))
    size = sum(map(os.path.getsize, files))
    if size > MAX_BYTES:
        raise ValueError(f"The compiled rules have {size} bytes, more than {MAX_BYTES}: split the list")
    for file in files:
        spark.sparkContext.addFile(file)
    return name


class Rules:
    """The mapped rules of a task."""

    def __init__(self, stem: str):
        self.hosts, self.rules = DigestArray(f"{stem}-hosts"), DigestArray(f"{stem}-rules")
        path = f"{stem}.lengths"
        self.lengths = np.memmap(path, np.int64, "r") if os.path.getsize(path) else np.zeros(0, np.int64)

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each (host, path) the longest rule that fits it and whether that blocks; None where none fits.

        A rule fits its host and all subdomains, and paths that start with its own. Host endings at
        a dot are probed at once for the whole batch, then host and path start of the rules they have.
        """
        endings: dict[str, list[str]] = {}
        for host in set(hosts):
            parts = host.split(".")
            endings[host] = [".".join(parts[i:]) for i in range(len(parts))]
        known = list({e for es in endings.values() for e in es})
        place = {e: int(at) for e, at in zip(known, self.hosts.find([e.encode() for e in known])) if at >= 0}
        probes, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for ending in endings[host]:
                at = place.get(ending)
                if at is not None:
                    for length in self.lengths[at + 1:at + 1 + int(self.lengths[at])].tolist():
                        if length <= len(path):
                            probes.append((ending, path[:length]))
                            owners.append(i)
        best: list[tuple[int, int, str, bool] | None] = [None] * len(hosts)
        for i, (host, path), verdict in zip(owners, probes, self.rules.find([f"{h}\n{p}".encode() for h, p in probes]).tolist()):
            if verdict >= 0:
                rank = (len(host) + len(path), len(host), host + path, verdict == 1)
                if best[i] is None or rank[:2] > best[i][:2]:
                    best[i] = rank
        return [b and b[2:] for b in best]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; path: then up to a question mark, hash or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substr(url, F.instr(url, "://") + 3), "?", 1), "#", 1))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    A url that no rule fits gets ``default``: the array lists what is ruled, so what it doesn't hold
    passes. A null url or one without ``://`` has an empty host and path, which only a rule of an
    empty host fits. Of two rules of one length the one with the longer host wins. Rows keep their
    number and order inside a task; repeated rows are judged each. Other columns are not read; no
    shuffle, so no host can be hot. ``rules`` are configuration of a checked size.
    """
    name = ship_rules(pages.sparkSession, rules)
    host, path = host_and_path(F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rules(SparkFiles.get(name))
        for batch in batches:
            judged = held.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array([j and j[0] for j in judged], pa.string()),
                 pa.array([default if j is None else "block" if j[1] else "allow" for j in judged], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
