"""Packing, mixing, sharding, toxicity, language model, chat format and the pipeline."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tableloom.llm import chat_format, language_model, mixing, packing, queries, sharding, toxicity


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "One two  three", "s2", 1), (2, None, None, 2), (3, "", "s1", 3), (4, "word " * 3000, "s1", 4), (1, "One two  three", "s2", 1), (None, "<|endoftext|> x", "s3", 5), (6, "日本 語 é", "s10", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, run int")


def encoder():
    import public_tokenizers as P

    return packing.Encoder(P.path(packing.TOKENIZER), P.path(packing.RANKS))


def test_ids_equal_the_tokenizers():
    e = encoder()
    texts = ["it's  ²³½ x\n\n y  ", "a\x85b \xa0 c\x1c\x1d d", "<|endoftext|> hi", "日本語 – “q” …", " \n\t ", "don't we'll ÀÿƀʼĿ·x×÷", "", "x" * 3000, " " * 500, "١٢٣ हिन्दी", "é ﻿"]
    for t in texts:
        assert list(np.frombuffer(e.encode(t), "<u4")) == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_and_gapless(odd):
    rows = packing.pack(odd).collect()
    e = encoder()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in odd.dropDuplicates(["doc_id", "text"]).collect():
        ids = e.encode(d.text or "") + (2).to_bytes(4, "little")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[d.doc_id]})
        assert sum(m[2] for m in mine) == len(ids) // 4 and all(m[2] == 1024 for m in mine[1:])
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in mine)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 1025, 200), rng.integers(1, 50, 200))}
    rows = packing.plan(counts)
    fill: dict = {}
    placed = Counter()
    for length, r0, r1, each, s0, at in rows:
        for k in range(r1 - r0):
            fill.setdefault(s0 + k // each, []).append((at + k % each * length, length))
        placed[length] += r1 - r0
    assert placed == Counter(counts)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    # one by one: the same number of sequences as best fit decreasing
    room: list = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        best = min((k for k in range(len(room)) if room[k] >= length), key=lambda k: room[k], default=None)
        if best is None:
            room.append(1024 - length)
        else:
            room[best] -= length
    assert len(fill) == len(room)


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([(1, "a", 1000), (2, "b", 10), (3, "c", 500), (4, None, 90), (5, "d", 0)], "doc_id int, source string, size long")
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    order, weight = ["a", "b", "c", "d", None], {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    size = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 90}
    target, left, free = {}, 1600.0, list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    assert all(math.isclose(got[s].target, target[s], abs_tol=1e-6) for s in order)
    assert [got[s].source_no for s in order] == [0, 1, 2, 3, 4]


def test_mix_takes_what_it_should(spark, odd):
    rng = np.random.default_rng(0)
    rows = [(k, "w " * int(n), f"s{k % 5}") for k, n in enumerate(rng.integers(0, 900, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit(0))
    got = mixing.taken_words(docs).collect()
    assert len(got) == 300 and all(0 <= r.taken <= 3 * r.size for r in got)
    by, goal = Counter(), {}
    for r in got:
        by[r.source_no] += r.taken
        goal[r.source_no] = r.target
    assert all(abs(by[s] - goal[s]) <= 3 * mixing.BLOCK for s in goal)
    assert sorted(got) == sorted(mixing.taken_words(docs.repartition(7)).collect())
    mixed = mixing.mixed_documents(docs)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert mixed.columns == docs.columns and words == sum(by.values())
    assert mixing.taken_words(odd).count() == odd.count() and mixing.taken_words(odd.limit(0)).count() == 0
    assert mixing.taken_words(odd.where("doc_id in (2, 3)")).select(F.sum("taken")).first()[0] == 0


def test_small_sources_reach_their_targets(spark):
    """Beside a source of 300 000 words, sources of a few words up to a few blocks; half the rows without an id and alike."""
    rows = [(None, "w " * 100, "a")] * 3000 + [(k, "w " * n, f"s{n}") for k, n in enumerate((10, 60, 129, 140, 300, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copy": F.lit("x"), "part": F.lit(1), "size": F.lit("y"), "slots": F.lit(0)})
    got = mixing.taken_words(docs).collect()
    assert len(got) == 3006 and all(r.taken <= 3 * r.size for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.target == 3 * r.size and r.taken >= 0.66 * r.target, r
    assert abs(sum(r.taken for r in got if r.doc_id is None) - next(r.target for r in got if r.doc_id is None)) <= 3 * mixing.BLOCK
    mixed = mixing.mixed_documents(docs)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert mixed.columns == docs.columns and words == sum(r.taken for r in got)


def test_shards(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    rows = sharding.shard(docs, 8).collect()
    size, places = Counter(), {}
    for r in rows:
        size[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 8
    assert max(size.values()) - min(size.values()) <= 97 + 16
    assert all(r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 97)) for r in rows)
    assert sharding.shard(odd, 3).count() == odd.count() and sharding.shard(odd.limit(0), 3).count() == 0


def test_shards_on_half_the_rows_equal(spark, tmp_path):
    """Against brute force: places, sizes, both versions of the map. Half the rows are one row, a third have no id."""
    rows = [(5, "the same row " * 9)] * 1500 + [(None if k % 3 == 0 else k, "x" * (k % 90)) for k in range(1500)] + [(7, None), (8, "é" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "copy": F.lit("c"), "part": F.lit(0), "shard": F.lit(9), "size": F.lit("s")})
    path = str(tmp_path / "map")
    got = sharding.shard(docs.repartition(5), 8, path).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    first, second = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert all(r.shard == first[r.virtual_slot] and r.next_shard == second[r.virtual_slot] in (r.shard, 8) for r in got)
    size, later, places = Counter(), Counter(), {}
    for r in got:
        if r.size < 80_000:  # the long row alone outweighs a shard's share
            size[r.shard] += r.size
        later[r.next_shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and later[8] > 0
    light = sorted(size.values())[-7:]
    assert light[-1] - light[0] <= 133
    slots = lambda g: Counter((r.doc_id, r.text_crc32, r.virtual_slot) for r in g)
    assert slots(got) == slots(sharding.shard(docs.repartition(3), 8).collect())


def test_growing_moves_slots_into_the_new_shard_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {k: int(v) for k, v in enumerate(rng.integers(1, 1000, 4000))}
    plan = sharding.plan_map(sizes, 10, 4000)
    grown = sharding.grow_map(plan, sizes)
    assert all(grown[s] in (plan[s], 10) for s in plan)
    held = Counter()
    for s, shard in grown.items():
        held[shard] += sizes[s]
    assert max(held.values()) < 1.05 * min(held.values())
    for version, m in ((1, plan), (2, grown)):
        sharding.save_map(spark, str(tmp_path / "map"), version, m, {})
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 2).collect()} == grown


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = [f"w{n}" for n in rng.integers(0, 300, 60)] + (["nasty", "vileword"] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words) + ". Another sentence"))
        marks.append((k, int(bad)))
    odd = [(900, None), (901, ""), (None, "no id, but a vileword and nasty"), (902, "long " * 60_000 + "nasty vileword")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"score": F.lit(1), "row": F.lit("r"), "toxic": F.lit(2)})
    labels = spark.createDataFrame(marks + [(900, None), (None, 1)], "doc_id long, toxic int")
    weights, bias = toxicity.train(docs, labels)
    got = toxicity.score(docs, weights, bias).select("row.doc_id", "score").collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got) and len(got) == 604
    slow = lambda t: 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in toxicity.features(t)))))
    assert all(math.isclose(r.score, slow(t), rel_tol=1e-9) for r, t in zip(sorted(got, key=lambda r: str(r.doc_id)), [t for _, t in sorted(rows + odd, key=lambda r: str(r[0]))]))
    assert min(r.score for r in got if r.doc_id in (None, 902)) > 0.7
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 440 <= kept.count() <= 460
    nothing, prior = toxicity.train(docs, labels.where("toxic = 0"))
    assert nothing == {} and prior < 0
    assert toxicity.train(docs.limit(0), labels)[0] == {} and toxicity.score(docs.limit(0), weights, bias).count() == 0


def test_an_id_that_repeats_stays_within_the_bound(spark):
    rows = spark.createDataFrame([(1, "the same text")] * 4000 + [(k, f"text {k}") for k in range(2, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    assert 200 < toxicity.labelled(rows, labels, False, 300).count() < 400


def test_the_penalty_spares_neutral_mentions(spark):
    """Toxic rows mention one group far more often. Without the penalty the mention alone raises a score."""
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for k in range(900):
        bad = k % 2 == 0
        words = [f"w{n}" for n in rng.integers(0, 400, 25)] + (["vileword"] if bad and rng.random() < 0.75 else [])
        words += ["women"] if rng.random() < (0.8 if bad else 0.08) else ["men"] if rng.random() < 0.5 else []
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = [" ".join(f"w{n}" for n in rng.integers(0, 400, 25)) + " women" for _ in range(300)]
    alarms = {}
    for penalty in (0.0, toxicity.PENALTY):
        weights, bias = toxicity.train(docs, labels, penalty=penalty)
        gap = weights.get("women", 0.0) - weights.get("men", 0.0)
        z = [bias + sum(weights.get(f, 0.0) for f in toxicity.features(t)) for t in neutral]
        caught = bias + weights["vileword"] + weights.get("women", 0.0)
        alarms[penalty] = (gap, sum(x > 0 for x in z) / len(z), caught)
    print(alarms)
    assert alarms[0.0][0] > 1 and abs(alarms[toxicity.PENALTY][0]) < 0.3
    assert alarms[0.0][1] > 0.5 and alarms[toxicity.PENALTY][1] < 0.2 and alarms[toxicity.PENALTY][2] > 0


def test_toxicity_on_the_tables(spark, query_sf):
    """Held-out rows of the given tables: the share of (toxic, clean) pairs in the right order."""
    got = queries.QUERIES["op6_toxicity"](spark, query_sf).join(spark.read.parquet(f"{query_sf}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r.score for r in got if r.toxic == t] for t in (1, 0))
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    print(f"AUC {auc:.3f} on {len(bad)} toxic and {len(good)} clean rows")
    assert auc > 0.7 and sum(x >= 0.7 for x in bad) >= 0.7 * len(bad) and sum(y >= 0.7 for y in good) <= 0.05 * len(good)


def test_swaps():
    assert toxicity.swapped("Some women came") == ["some men came"] and toxicity.swapped("nobody") == []


def spoken(seed: int = 4, n: int = 300):
    """Texts whose next word depends on the two before."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        w = ["on", "the"]
        for x in rng.random(40):
            step = zlib.crc32(f"{w[-2]} {w[-1]}".encode()) % 7
            w.append(f"word{(step * 11 + int(x * 3)) % 60}{'ab'[step % 2]}" if x < 0.8 else f"odd{int(x * 1e6)}")
        rows.append((k, " ".join(w) + (f" Rare{k}" if k % 3 else "")))
    return rows


def slow_log(model, word: bytes, one: bytes, two: bytes, counts: dict) -> float:
    """log10 p(word | the word before, the one before that), by plain numbers."""
    L, full = language_model, 2**64 - 1
    code = lambda w: model.codes.get(w, (65_536 + zlib.crc32(w)) * L.CLASSES + L.class_of(w))

    def mixed(x):
        x &= full
        x = (x ^ (x >> 29)) * L.MIX[1] & full
        return x ^ (x >> 32)

    a, b, c = code(one) * L.MIX[0], code(two) * L.MIX[1], L.class_of(word)
    top = L.CONTEXT_BITS - 13
    both = (mixed(a + b + L.MIX[2]) >> (64 - top)) << 13 | 1 << 12 | L.class_of(two) * L.CLASSES + L.class_of(one)
    near, far = ((mixed(h) >> (64 - top)) << 13 | mixed(h) & 0xFFF for h in (a + 1, b + 2))
    if not hasattr(model, "plain"):
        model.plain = [{int(k): float(v) for k, v in zip(*model.table[i : i + 2]) if k != full} for i in (0, 2)]
        model.numbers = {w: x // L.CLASSES for w, x in model.codes.items()}
    norms, weights = model.plain
    out = float(model.log_class[L.class_of(two) * L.CLASSES + L.class_of(one), c])
    if both << 7 | L.CLASSES in norms:
        out += weights.get(both << 16 | L.WHOLE + c, 0.0) - norms[both << 7 | L.CLASSES]
    for context in (both, near, far):
        if context << 7 | c in norms:
            out += weights.get(context << 16 | model.numbers.get(word, L.RARE + c), 0.0) - norms[context << 7 | c]
            break
    return out / math.log(10) + math.log10((counts.get(word, 0) + L.ALPHA) / model.in_class[c])


def test_language_model(spark):
    """The base score and the model's score against plain sums over the tokens."""
    rows = spoken()
    rows += [(1000, None), (1001, ""), (None, rows[7][1]), (1, rows[1][1]), (1002, "the " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "row": F.lit(1), "n": F.lit(2)})
    got = language_model.score(docs, steps=4).collect()
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) for w in t if not h)
    n, v = sum(c.values()), len(c)
    base = [round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6) for t in tokens]
    want = sorted(((d, h, len(t), sum(c[w] > 0 for w in t), n, b) for (d, _), h, t, b in zip(rows, held, tokens, base)), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    model = language_model.Model(docs, steps=4)
    slow = {}
    for (d, _), t in zip(rows[:40], tokens):
        slow[d] = sum(slow_log(model, w, one, two, c) for w, one, two in zip(t, [b"\n", *t], [b"\n", b"\n", *t]))
    for r in got:
        if r.doc_id in slow and r.doc_id != 1:
            assert math.isclose(r.score, slow[r.doc_id], abs_tol=1e-3)
    gain = sum(r.score - r.base_score for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    print(f"held-out gain {gain:.2f} log10 a token")
    assert gain > 0.5
    assert language_model.score(docs.limit(0), steps=1).count() == 0


def test_language_model_is_a_distribution(spark):
    """Over all words, and an unseen one for each class, p sums to one whatever went before."""
    docs = spark.createDataFrame(spoken(5, 120), "doc_id long, text string")
    model = language_model.Model(docs, steps=3)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    histories = [(b"the", b"on"), (b"on", b"\n"), (b"\n", b"\n"), (b"never", b"seen"), (b"the", b"never")]
    frequent = list(model.codes)
    histories += [(frequent[k], frequent[k * 2 + 1]) for k in range(1, 12)]
    unseen = {language_model.class_of(w): w for w in (f"zq{k}".encode() for k in range(2000)) if w not in counts}
    unseen[language_model.END_CLASS] = None
    assert len(unseen) == language_model.CLASSES and len(model.table[0][model.table[0] != 2**64 - 1]) > 20
    for one, two in histories:
        total = sum(10 ** slow_log(model, w, one, two, counts) for w in counts)
        for c, w in unseen.items():  # the end's class keeps an unseen word as well
            total += 10 ** slow_log(model, w, one, two, counts) if w else language_model.ALPHA / (counts[b"\n"] + language_model.ALPHA) * 10 ** slow_log(model, b"\n", one, two, counts)
        assert math.isclose(total, 1, abs_tol=2e-4), (one, two, total)


def test_more_frequent_words_than_the_table_holds(spark):
    rows = [(f"w{k:02d}".encode(), 200_000 + k // 2) for k in range(8)] + [(b"x", 3), (b"\n", 900_000)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    assert language_model.frequent_words(counts, 3) == {b"w06": 200_003, b"w07": 200_003, b"w04": 200_002}
    assert language_model.frequent_words(counts, 20) == {w: n for w, n in rows if w != b"\n"}
    assert language_model.frequent_words(counts.limit(0), 3) == {}


def test_blocks_of_keys_come_back():
    rng = np.random.default_rng(3)
    keys, n = np.unique(rng.integers(0, 2**52, 5000, np.uint64) // np.uint64(2**38), return_counts=True)
    back = language_model.unpacked(*language_model.packed(keys, n))
    assert (back[0] == keys).all() and (back[1] == n).all() and n.max() > 1


def test_quotations_are_linked_and_ordered(spark):
    a, b = "How do I sort a big list?\nI have many rows.", "Use a heap, they work.\n\nOr a merge sort maybe."
    rows = [
        (1, 0, "user", a), (1, 1, "assistant", "> How do I sort a big list?\n" + b), (1, 2, "user", "On Monday X wrote:\n> > How do I sort a big list?\n> Use a heap, they work.\nThanks a lot for this one"),
        (2, 0, "user", "> Or a merge sort maybe.\nWhat about radix sort then?"), (2, 1, "assistant", None), (3, 0, "user", ""), (None, 1, "user", "> Use a heap, they work.\nhm"),
        (1, 1, "assistant", "> How do I sort a big list?\n" + b), (4, 0, "user", ">> unknown text here\n> other unknown"), (5, 0, "user", "a > b stays\n-> so does this"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("x"))
    got = sorted(((r.thread_conv, r.position, r.conv_id, r.turn, r.text, r.quote_depth, r.reply_conv, r.reply_turn, r.reply_depth) for r in chat_format.conversations(df).collect()), key=repr)
    assert got == sorted([
        (1, 0, 1, 0, a, 0, None, None, 0), (1, 1, 1, 1, b, 1, 1, 0, 1), (1, 2, 1, 1, b, 1, 1, 0, 1), (1, 3, 1, 2, "Thanks a lot for this one", 2, 1, 1, 2),
        (1, 4, 2, 0, "What about radix sort then?", 1, 1, 1, 2), (2, 0, 2, 1, "", 0, None, None, 0), (3, 0, 3, 0, "", 0, None, None, 0), (None, 0, None, 1, "hm", 1, None, None, 0),
        (4, 0, 4, 0, "", 2, None, None, 0), (5, 0, 5, 0, "a > b stays\n-> so does this", 0, None, None, 0),
    ], key=repr)
    assert chat_format.conversations(df.limit(0)).count() == 0


QUOTES = ["Use a heap, they work well.", "What about the radix sort then?", "I do not think that it is stable.", "See the manual, page forty.", "short", "The same line that all quote here."]


def threads(seed: int, n: int = 60):
    """Conversations that quote lines and whole messages, at up to three levels, their own and others', some edited, some alike."""
    rng = np.random.default_rng(seed)
    said, rows = [], []
    for conv in range(n):
        for turn in range(int(rng.integers(1, 7))):
            parts = []
            for _ in range(int(rng.integers(0, 3))):
                if said and rng.random() < 0.8:
                    whole = said[int(rng.integers(len(said)))] if rng.random() < 0.5 else QUOTES[int(rng.integers(len(QUOTES)))]
                    lines = whole.split("\n") if rng.random() < 0.6 else [whole.split("\n")[0]]
                    if rng.random() < 0.2:
                        lines = [x + " edited" for x in lines]
                    if rng.random() < 0.4:
                        parts.append("On Monday " + "x" * int(rng.integers(1, 400)) + " wrote:")
                    mark = [">", "> >", ">>>"][int(rng.integers(3))]
                    parts += [f"{mark} {x.upper() if rng.random() < 0.3 else x}" for x in lines]
                parts.append(QUOTES[int(rng.integers(len(QUOTES)))] if rng.random() < 0.5 else f"Message {conv} of turn {turn} has its own line.")
            text = "\n".join(parts)
            rows.append((conv, turn, ["user", "assistant"][turn % 2], text))
            said.append("\n".join(p for p in parts if not p.startswith((">", "On Monday"))) or "nothing was said")
    return rows


def slow_threads(rows):
    """(conv_id, turn) -> what it replies to, by comparing all messages."""
    intro = re.compile(r"^\s*(on\b.*\bwrote|.+\b(wrote|schrieb|a écrit|escribió))\s*:\s*$", re.I)
    level = lambda x: re.match(r"(?:[ \t]*>)*", x)[0].count(">")
    norm = lambda x: re.sub(r"\s+", " ", x).strip().lower()

    def units(text):
        parts = {norm(x) for x in [text, *re.split(r"\n\s*\n", text), *text.split("\n")]}
        return {x for x in parts if len(x) >= 12 or x == norm(text) and x}

    own, quoted = {}, {}
    for conv, turn, _, text in rows:
        lines = re.split("\r?\n", text)
        levels = [level(x) for x in lines]
        body = [re.sub(r"^(?:[ \t]*>)+", "", x).strip(" ") for x in lines]
        keep = [x for k, x in enumerate(lines) if not levels[k] and not (intro.match(x) and k + 1 < len(lines) and levels[k + 1])]
        own[conv, turn] = units("\n".join(keep).strip() if any(levels) else text)
        runs = []
        for k, x in enumerate(body):
            if levels[k] and k and levels[k] == levels[k - 1]:
                runs[-1][1].append(x)
            elif levels[k]:
                runs.append((levels[k], [x]))
        quoted[conv, turn] = [(lv, u) for lv, xs in runs for u in units("\n".join(xs))]
    out = {}
    for me, found in quoted.items():
        best = None
        for lv, u in found:
            before = [o for o in own if o < me and u in own[o]]
            here = [o for o in before if o[0] == me[0]]
            for o in [min(here)] if here else [min(before)] if before else []:
                rank = (-lv, len(u), o[0] == me[0], -o[0], -o[1])
                best = max(best or (rank, o), (rank, o))
        out[me] = best and best[1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_quotations_against_brute_force(spark, tmp_path, seed):
    from oracle import compare

    rows = threads(seed)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op4_chat_format"](spark, str(tmp_path)).collect()
    links = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) if r.reply_conv is not None else None for r in got}
    want = slow_threads(rows)
    assert links == want and sum(v is not None for v in want.values()) > 60 and len({v[0] == k[0] for k, v in want.items() if v}) == 2
    place = {(r.conv_id, r.turn): (r.thread_conv, r.position) for r in got}
    for me, up in want.items():
        assert up is None or place[me][0] == place[up][0] and place[me][1] > place[up][1]
    assert max(r.reply_depth for r in got) >= 3 and max(r.quote_depth for r in got) == 3
    compare(queries.QUERIES["op4_chat_format"](spark, str(tmp_path)), queries.ORACLE_SQL["op4_chat_format"], str(tmp_path))


@pytest.mark.parametrize("shape", ["random", "star", "chain"])
def test_walks_of_reply_trees(spark, shape):
    """Forests, one message with very many replies, and a chain of 100 000: the order of a walk, roots and depths."""
    rng = np.random.default_rng(3)
    n = 100_000 if shape == "chain" else 2000
    up = {k: k - 1 if shape == "chain" else 0 if shape == "star" else int(rng.integers(max(0, k - 40), k)) for k in range(1, n) if shape != "random" or k % 50}
    node = lambda k: (k // 7, k % 7)
    links = spark.createDataFrame([(*node(k), *node(p)) for k, p in up.items()], "conv_id long, turn int, reply_conv long, reply_turn int")
    got = {(r.conv_id, r.turn): r for r in chat_format.reply_places(links).collect()}
    children: dict = {}
    for k in sorted(up):
        children.setdefault(up[k], []).append(k)
    assert len(got) == len(up)
    for root in [k for k in children if k not in up]:
        walk, todo = [], [(root, 0)]
        while todo:
            k, depth = todo.pop()
            walk.append((k, depth))
            todo += [(c, depth + 1) for c in reversed(children.get(k, ()))]
        rows = [got[node(k)] for k, _ in walk[1:]]
        assert all((r.thread_conv, r.thread_turn) == node(root) and r.reply_depth == d for r, (_, d) in zip(rows, walk[1:]))
        assert all(a.place < b.place for a, b in zip(rows, rows[1:]))


def test_a_line_that_all_quote_and_a_very_long_text(spark):
    rows = [(0, 0, "user", "The same line that all quote here."), (0, 1, "user", "The same line that all quote here.")]
    rows += [(k, 0, "user", f"> The same line that all quote here.\nMy own answer {k}") for k in range(1, 400)]
    rows += [(500, 0, "user", "long line " * 30_000 + "\n> " + "quote " * 20_000 + "\n> The same line that all quote here.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "hash": F.lit("h"), "level": F.lit(2), "at": F.lit(3), "part": F.lit(4)})
    got = chat_format.conversations(table).collect()
    assert len(got) == len(rows) and {(r.reply_conv, r.reply_turn) for r in got if r.conv_id} == {(0, 0)}
    assert next(r.reply_conv for r in got if (r.conv_id, r.turn) == (0, 1)) is None
    assert {r.thread_conv for r in got} == {0} and sorted(r.position for r in got if r.conv_id or not r.turn) != []


def test_registered_queries_match_sql(spark, sf):
    from oracle import compare

    for name, sql in queries.ORACLE_SQL.items():
        compare(queries.QUERIES[name](spark, sf), sql, sf)


def test_language_model_adds_keys_up_in_place():
    """A flush and a group hold little beside their keys, and count as np.unique does."""
    import tracemalloc

    rng = np.random.default_rng(3)
    held = [rng.integers(0, 2**52, 30_000).astype(np.uint64) % np.uint64(2**40) for _ in range(3 * 13)] + [np.arange(500, dtype=np.uint64)] * 2
    want = np.unique(np.concatenate(held), return_counts=True)
    tracemalloc.start()
    begun = tracemalloc.get_traced_memory()[0]
    keys, n = language_model.summed(held)
    grown = tracemalloc.get_traced_memory()[1] - begun
    tracemalloc.stop()
    assert (keys == want[0]).all() and (n == want[1]).all() and not held
    assert grown < 6 * want[0].nbytes


def task(stub):
    """The function that an operator, called with the stub, gives to mapInArrow."""
    return stub.select.return_value.mapInArrow.call_args[0][0]


def test_packing_starts_no_second_set_of_workers(odd):
    """The slot table is local data, not an RDD of pickled rows with Python workers of its own."""
    plan = packing.pack(odd)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


def test_toxicity_holds_few_counts(spark):
    """What a task sends at once, and so holds, stays small within a batch too, and adds up to all counts."""
    from unittest.mock import MagicMock

    import pyarrow as pa

    texts = [" ".join(f"{k * 400 + i:06d}x" for i in range(500)) for k in range(400)]  # 160 100 words, each in two texts at most
    stub = MagicMock()
    toxicity.feature_counts(stub)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 for k in range(400)], pa.int32())], ["text", "toxic"])
    sent = list(task(stub)(iter([batch] * 2)))
    got, want = (Counter(), Counter()), (Counter(), Counter())
    for b in sent:
        for f, *n in zip(*(c.to_pylist() for c in b.columns)):
            for toxic in (0, 1):
                got[toxic][f] += n[toxic]
    for k, t in enumerate(texts):
        for f in toxicity.features(t):
            want[k % 2][f] += 2
    assert all(+g == w for g, w in zip(got, want))
    assert max(b.num_rows for b in sent) <= 110_000


def test_sketches_hold_one_text(spark):
    """Hashes are numbers of Python's, forty bytes each: those of a text are let go before the next one's are made."""
    import tracemalloc
    from unittest.mock import MagicMock

    import pyarrow as pa
    from tableloom.llm import near_jaccard

    texts = [" ".join(f"{k}w{i}" for i in range(1000)) for k in range(500)]
    stub, levels = MagicMock(), MagicMock(value=np.zeros(near_jaccard.CELLS, np.uint8))
    stub.sparkSession.conf.get.return_value = "1000"
    near_jaccard.sketches(stub, levels)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(range(500)), pa.array(texts)], ["doc_id", "text_key", "text"])
    tracemalloc.start()
    out = list(task(stub)(iter([batch])))[0].to_pylist()
    grown = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = near_jaccard.shingle_set(texts[7])
    assert out[7]["node"] == near_jaccard.set_key(held) and out[7]["n"] == len(held) == 996
    assert grown < 8_000_000  # 498 000 hashes as numbers of Python's are 20 MB


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert 0.5 * before < docs.count() < before and docs.select("doc_id").distinct().count() == docs.count()
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    total = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert abs(total(mixed) - total(docs)) < 0.05 * total(docs)
    packed = corpus_pipeline.packing_stage(spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count() and packed.columns[:2] == ["doc_id", "piece"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, held against plain Python."""
    from test_llm_dedup import sentence, union_find

    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        words = sentence(100 + k, 120).split()
        rows.append((k, " ".join(words)))
        if k % 8 == 0:
            rows.append((500 + k, " ".join(words).upper()))
        if k % 5 == 0:
            near = list(words)
            for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
                near[at] = "edited"
            rows.append((700 + k, " ".join(near)))
        if k % 4 == 0:
            rows.append((1000 + k, f"{sentence(400 + k, 40)} vileword nasty {sentence(800 + k, 40)}"))
    docs = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 0, int(d >= 1000)) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, steps = str(tmp_path), {}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.materialize(stage(spark, table, folder), name)
        steps[name] = table.collect()
    text = dict(rows)
    kept = {d for d in text if "vileword" not in text[d]}
    assert {r.doc_id for r in steps["toxicity"]} == kept
    last: dict = {}
    for d in sorted(kept):
        last[text[d].lower()] = d
    assert {r.doc_id for r in steps["exact_dedup"]} == set(last.values())
    left = sorted(last.values())
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text[d].lower().split() for d in left)]
    comp = union_find(len(left), [(a, b) for a in range(len(left)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])])
    want = {d for k, d in enumerate(left) if comp[k] == k}
    assert {r.doc_id for r in steps["simhash_near_dedup"]} == want and len(want) < len(left) < len(kept)
    size = {s: sum(len(text[d].split()) for d in want if d % 3 == s) for s in range(3)}
    took = Counter()
    for r in steps["mixing"]:
        assert f" {r.text} " in f" {text[r.doc_id]} " and r.n_chars == len(r.text) and r.doc_id in want
        took[r.doc_id % 3] += len(r.text.split())
    goal = {s: sum(size.values()) * (s + 1) / 6 for s in range(3)}
    assert max(g / size[s] for s, g in goal.items()) < 3 and all(abs(took[s] - goal[s]) <= 3 * mixing.BLOCK for s in range(3))
    e, ids = encoder(), Counter()
    for r in steps["mixing"]:
        ids[r.doc_id, len(e.encode(r.text)) // 4 + 1] += 1
    packed: dict = {}
    for r in steps["packing"]:
        packed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter((r.doc_id, r.length) for r in steps["packing"]) == ids  # none is longer than a sequence
    for parts in packed.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 1024


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names, an empty table."""
    rows = [(k, f"plain words number {k} and some more of the same kind {k * 7}", "en", "s1", 40) for k in range(20)]
    rows += [(k, f"nasty text {k} with a vileword in it", "en", "s2", 30) for k in range(20, 32)]
    rows += [(50, None, None, None, None), (51, "", "de", "s1", 0), (None, "no id at all here", "fr", None, 17), (52, "long " * 9000, "en", "s3", 45000)]
    rows += [rows[0], rows[0], (1, "another text of the id one, by an other source", "en", "s9", 46), (60, rows[2][1].upper(), "en", "s1", 40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"row": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5), "slot": F.lit(None).cast("int"), "fp": F.lit(2)})
    labels = spark.createDataFrame([(k, 0, int(k >= 20)) for k in range(32)] + [(None, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("full", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        step = spark.read.parquet(f"{folder}/documents.parquet")
        counts = []
        for stage, run in corpus_pipeline.STAGES[:-1]:
            step = corpus_pipeline.materialize(run(spark, step, folder), stage)
            assert step.columns == docs.columns, stage
            counts.append(step.count())
        if name == "none":
            assert counts == [0, 0, 0, 0] and corpus_pipeline.run(spark, folder).count() == 0
        else:
            # three copies of a row, its upper-cased twin and the two empty texts go in exact dedup
            assert counts[0] >= 28 and counts[1] == counts[0] - 4 and counts[2] <= counts[1]
            packed = corpus_pipeline.run(spark, folder)
            assert packed.where("piece = 0").count() == counts[3] and packed.where("length > 1024 or length < 1").count() == 0
