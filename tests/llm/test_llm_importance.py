"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tableloom.llm import importance


def grams(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, percent=25, min_words=20, buckets=10_000, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc_id, text in rows:
        n, found = grams(text)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = may[: percent * len(may) // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(drawn)}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "naïve", "日本", "x1", "a-b", "don't"] + [f"w{k}" for k in range(300)]
    return [(k, " ".join(words[j] for j in rng.zipf(1.4, rng.integers(0, 80)) % len(words))) for k in range(n)]


@pytest.mark.parametrize("block", [50, 250_000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(importance.blocks, "__defaults__", (block,))
    rows = corpus(1, 300) + [(1000, None), (1001, ""), (1002, " .,;"), (1003, "ß" * 40 + " " + "y" * 200 + " z" * 30), (None, "w1 w2 " * 30), (7, corpus(1, 8)[7][1]), (7, "w3 " * 25)]
    rows += [(2000 + k, "hot words " * 15) for k in range(150)]
    target = [t for _, t in corpus(2, 20)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "part", "score", "bucket", "nth")})
    got = importance.resample(docs.repartition(6), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(corpus(3, 40), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert sorted((tuple(r) for r in importance.resample(docs, none, percent=50).collect()), key=repr) == brute(corpus(3, 40), [], percent=50)


def test_long_texts_are_cut_between_words():
    text = " ".join(f"a{k}" for k in range(5000)) + " " + "b" * 3000 + " c"
    seen = Counter()
    for data, starts, lengths, index, words in importance.blocks(["x", text], 1000):
        assert len(data) < 5000
        seen.update(data[s : s + n].decode() for s, n in zip(starts.tolist(), lengths.tolist()))
    assert seen == Counter(["x"]) + Counter(grams(text)[1])


def test_equal_hashes_are_told_apart():
    """All keys alike: only the bytes part the n-grams."""
    data = b"one two one a23456789 a2345678X one\n"
    starts, lengths = np.array([0, 4, 8, 12, 22, 32]), np.array([3, 3, 3, 9, 9, 3])
    slot, owners = importance.intern(np.zeros(6, np.uint64), importance.lanes_of(data), starts, lengths)
    assert len(owners) == 4 and slot[0] == slot[2] == slot[5] and len(set(slot.tolist())) == 4


def test_hashes_equal_the_libraries():
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8).tobytes()
    starts = rng.integers(0, 3900, 500)
    lengths = np.r_[np.arange(100), rng.integers(1, 40, 400)]
    spans = [data[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
    assert importance.xxhash64(data, importance.lanes_of(data), starts, lengths).tolist() == [xxh64_intdigest(x) for x in spans]
    some = lengths > 0
    assert importance.crc32(data, starts[some], lengths[some]).tolist() == [zlib.crc32(x) for x in spans if x]


def test_the_draw_leans_to_the_target(spark):
    rng = np.random.default_rng(4)
    like = lambda words: " ".join(rng.choice(words, 60))
    a, b = [f"left{k}" for k in range(50)], [f"right{k}" for k in range(50)]
    rows = [(k, like(a if k % 4 else b)) for k in range(400)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(like(b),) for _ in range(30)], "text string"))
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(k % 4 == 0 for k in drawn) > 60
