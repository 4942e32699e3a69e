"""Phrase mining, filter audit and URL filter against plain Python."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from citesieve.llm import filter_audit, phrases, url_filter
from citesieve.llm.common import stage

DOCUMENTS = "doc_id long, text string, lang string, shard long, word string, n long, part string, name long"
LABELS = "doc_id long, quality int, toxic int, part string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "w", 2, "p", 3) for r in rows], DOCUMENTS).repartition(parts)


# 11 phrases

def brute_phrases(rows, support, top=2000, covered=100, longest=5):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {x: c for x, c in f.items() if c >= support and len(x[1]) > 1}
    best = defaultdict(int)
    for (lang, p), c in candidates.items():
        for k in range(1, len(p)):
            for i in range(len(p) - k + 1):
                best[lang, p[i:i + k]] = max(best[lang, p[i:i + k]], c)
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if best[lang, p] and 100 * best[lang, p] >= covered * a:
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


def phrase_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "x y", "\x1cq", "B", "b"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ", ", "\n", "  ", "."]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, ""])))
    rows += [(i, "the quick brown fox jumps over THE lazy dog; the the the the", "en") for i in range(200, 230)]
    return rows + [(500, None, "en"), (501, "", "fr"), (502, " ,.;! ", "fr"), (None, "w1 w2", None), (503, "w3 " * 4000, "de"), rows[0], rows[0]]


def found_phrases(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("support,shard,bits", [(12, 2_000_000, 25), (12, 300, 25), (3, 50, 15), (40, 1, 16)])
def test_phrases_equal_plain_counting(spark, monkeypatch, support, shard, bits):
    """Also with shards so small that a share of the support is one occurrence, and a bitmap so full that it marks everything."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "BITMAP_BITS", bits)
    rows = phrase_rows()
    got = found_phrases(phrases.mine_phrases(frame(spark, rows), support=support))
    want = brute_phrases(rows, support)
    assert got == want
    assert len(want) > 5


def test_phrases_limits_and_cover(spark):
    rows = phrase_rows()
    got = found_phrases(phrases.mine_phrases(frame(spark, rows, 5), support=8, top=3, covered=60))
    assert got == brute_phrases(rows, 8, 3, 60)
    assert phrases.mine_phrases(frame(spark, []), support=8).count() == 0
    assert phrases.mine_phrases(frame(spark, [(1, None, None), (2, "a b c", "en")]), support=2).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([([3_000_000_000, 2_000_000_000], [3_000_000_007, 2_000_000_000], 2, 2_000_000_000, 9_000_000_000_000)],
                                "heads array<long>, tails array<long>, size int, f long, n long")
    c = row.select(phrases.weakest_cut(row.n).alias("c")).first()["c"]
    assert c["score"] == 1000 * 2_000_000_000 * 9_000_000_000_000 // (3_000_000_000 * 3_000_000_007)


def test_local_pass_marks_what_is_frequent_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 1500)
    rows = phrase_rows()
    found, totals = phrases.frequent_phrases(frame(spark, rows), 120, 2)
    encoded = stage(phrases.shards(frame(spark, rows)).where("n > 0"), "t").join(totals, "lang").select("n", "total", "lang", "words", "length", "codes")
    assert encoded.count() > 4
    bits = phrases.united(phrases.locally_frequent(encoded, [], 120))
    every = spark.sparkContext.broadcast(np.full(1 << 22, 255, np.uint8))
    counts = phrases.counted(encoded, [], every).groupBy("lang", "phrase").sum("n").toPandas()
    marked = phrases.is_set(bits, phrases.spot(phrases.marks_of([p.encode() for p in counts.phrase])))
    often = (counts["sum(n)"] >= 120).to_numpy()
    assert marked[often].all() and often.sum() > 3 and (~marked).any()
    assert counts["sum(n)"].sum() == totals.agg({"total": "sum"}).first()[0]


def test_union_leaves_out_rare_phrases_where_a_share_is_one_occurrence(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 1)
    docs = frame(spark, [(i, f"common rare{i}", "en") for i in range(150)])
    encoded = stage(phrases.shards(docs), "t").selectExpr("*", "300L AS total")
    bits = phrases.united(phrases.locally_frequent(encoded, [], 100))
    assert np.unpackbits(bits).sum() == 1 and phrases.is_set(bits, phrases.spot(phrases.marks_of([b"common"]))).all()


def test_levels_of_a_shard_hold_no_arrays_of_all_places(monkeypatch):
    rng = np.random.default_rng(5)
    marks, codes = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 5001, 1_000_000).astype(np.int32)
    half, few = (np.packbits(rng.random(1 << 20) < share, bitorder="little") for share in (0.7, 0.05))
    tracemalloc.start()
    places, found = phrases.level_of(marks, codes, [half] * 2, few)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and 1000 < len(places) < 30_000  # three arrays of all places alone would be 20 MB
    monkeypatch.setattr(phrases, "SLICE", len(codes))
    whole = phrases.level_of(marks, codes, [half] * 2)
    keep = phrases.holds(few, whole[1])
    assert (places == whole[0][keep]).all() and (found == whole[1][keep]).all()
    monkeypatch.setattr(phrases, "SLICE", 3)
    short = phrases.level_of(marks, codes[:400], [half] * 2)
    n = np.searchsorted(whole[0], 398)
    assert (short[0] == whole[0][:n]).all() and (short[1] == whole[1][:n]).all()


# 12 filter audit

def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    cells = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good = any(d == i and q == 1 for d, q, _ in labels if i is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if i is not None)
        cells[lang or ""].append((frozenset(f for f in fails if fails[f]), good, toxic))
    out = {}
    for part, docs in cells.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                failing = [d for d in docs if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs),
                                                   sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = shapley[values[-1]]
    return out


def audit_rows():
    rng = random.Random(9)
    long = " ".join(f"word{i}" for i in range(230))
    dull = "same old words again " * 60
    texts = [None, "", "short", long, long, dull, dull + "#", "SHOUT " * 210, "LOUD but VARIED " + long.upper(), long + " 100%", "a b\x1cc " * 250, "é" * 300]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(90)]
    return rows + [(3, long, "en"), (3, long, "en"), (None, long, "en"), (None, None, None), (900, "x " * 300_000, "de")]


@pytest.mark.parametrize("size", [8 << 20, 2000, 1])
def test_audit_equals_plain_orders(spark, monkeypatch, size):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    rows = audit_rows()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 2)] + [(3, 1, None), (3, 0, 1), (4, None, None), (None, 1, 1), (7777, 1, 1)]
    got = filter_audit.filter_audit(frame(spark, rows), spark.createDataFrame([(*r, "p") for r in labels], LABELS))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    have = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got.collect()}
    assert have == brute_audit(rows, labels)
    assert len(have) == 3 * 600


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(frame(spark, []), labels).count() == 0
    one = filter_audit.filter_audit(frame(spark, [(1, None, None)]), labels).collect()
    assert {(r["part"], r["kept"] + r["removed"]) for r in one if r["step"] == 1} == {("", 1)} and len(one) == 600


def test_matrix_is_a_csr_of_global_words(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 500)
    rows = audit_rows()[:40]
    shards = filter_audit.matrix(frame(spark, rows)).collect()
    assert len(shards) > 3
    seen = defaultdict(Counter)
    for s in shards:
        assert len(s["starts"]) == len(s["doc_id"]) + 1 and s["starts"][-1] == len(s["gaps"]) == len(s["counts"])
        for i, doc in enumerate(s["doc_id"]):
            columns = np.cumsum(s["gaps"][s["starts"][i]:s["starts"][i + 1]], dtype=int).tolist()
            assert columns == sorted(set(columns))
            seen[doc].update(dict(zip(columns, s["counts"][s["starts"][i]:s["starts"][i + 1]])))
    words = {i: Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert {i: sorted(c.values()) for i, c in seen.items()} == {i: sorted(c.values()) for i, c in words.items()}
    share = Counter(w for c in words.values() for w in c)
    assert sorted(Counter(x for c in seen.values() for x in c).values()) == sorted(share.values())  # one column per distinct word


# 13 URL filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("block", "a.b.org", ""), ("allow", "a.b.org", "/x"), ("block", "long.io", "/p/q"), ("allow", "io", "/p/q/r/s"), ("block", "", "/"), ("allow", "twice.de", "/"),
         ("block", "TWICE.de", "/")]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*((?:/[^?#]*)?)", rest)[1]
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in ((v, h.lower(), p) for v, h, p in rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "allow" if best is None else "block" if best[2] else "allow"


def urls():
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "x.example.net", "badexample.net", "Example.COM", "org", "a.b.org", "c.a.b.org", "b.org", "long.io", "x.long.io", "twice.de", "",
             "net:80", "user@x.net", "net.", ".net", "a..net", "é.org"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/1", "/fr/?a=/en/", "?q=http://x.net/", "#frag", "/x/y", "/p/q/r/s/t", "/p/q/r", "/en/#x?y", "//en/"]
    made = [rng.choice(["http", "https", "", "a:b"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(700)]
    return made + [None, "", "no scheme", "://", ":///", "http:/x.net/", "http://a.net/" + "p" * 100_000, "x?u=http://y.net/z"]


def test_urls_equal_plain_rules(spark):
    data = [(i, u, "h", "p", "r", "v") for i, u in enumerate(urls())] + [(None, "http://a.net/", None, None, None, None)] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, host string, path string, rule string, verdict string").repartition(3)
    got = url_filter.judge_urls(pages, RULES).collect()
    assert len(got) == len(data)
    want = {i: brute_url(u, RULES) for i, u, *_ in data}
    for r in got:
        assert tuple(r[c] for c in ("host", "path", "rule", "verdict")) == want[r["page_id"]], r["page_id"]
    assert len({w[2] for w in want.values()}) > 6
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    none = url_filter.judge_urls(pages, []).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def test_url_rules_are_checked(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for wrong in (("deny", "a", "/"), ("block", "a/b", "/"), ("block", "a", "b")):
        with pytest.raises(ValueError):
            url_filter.judge_urls(pages, [wrong])
    monkeypatch.setattr(url_filter, "MAX_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, RULES)


def test_digest_array_confirms_strings(folder):
    """Strings that share a digest are told apart by their stored text; what is absent is not found."""
    def weak(s):
        return len(s) % 3

    entries = [(f"host{i}.{'x' * (i % 7)}".encode(), i) for i in range(200)]
    url_filter.DigestArray.write(f"{folder}/t", entries, weak)
    array = url_filter.DigestArray(f"{folder}/t", weak)
    probes = [s for s, _ in entries] + [b"absent", b"", b"host5"]
    assert array.find(probes).tolist() == [*range(200), -1, -1, -1]
    assert isinstance(array.keys, np.memmap)
    url_filter.DigestArray.write(f"{folder}/none", [])
    assert url_filter.DigestArray(f"{folder}/none").find([b"a"]).tolist() == [-1]
