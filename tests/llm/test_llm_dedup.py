"""Exact, substring, SimHash and embedding deduplication against brute force on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tableloom.llm import components, embedding_dedup, exact_dedup, simhash, substring_dedup

WORDS = [f"w{k}x{k * 7 % 13}" for k in range(400)]


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = sentence(1, 6000)
    rows = [(1, "Same text", "a"), (2, "same TEXT", "b"), (3, None, None), (4, "", "c"), (5, long, "d"), (6, long.upper(), "e"), (7, long + " tail", "f"),
            (8, "Ärger", "g"), (9, "ärger", "h"), (2, "same TEXT", "b"), (None, "alone", "i"), (11, "same text", "j")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnRenamed("key", "row")


def test_exact_groups(odd):
    found = exact_dedup.exact_duplicates(odd).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    want = {}
    for r in odd.collect():
        want.setdefault(hashlib.sha256(lower(r.text).encode()).hexdigest(), []).append(r.doc_id)
    assert len(found) == odd.count()
    for r in found:
        ids = want[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in found) == len(want)
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(want)
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_chunks_are_the_text(odd):
    from pyspark.sql import functions as F

    got = odd.where("text is not null").select("text", F.array_join(exact_dedup.chunk_texts(F.col("text")), "").alias("again"), F.size(exact_dedup.chunk_texts(F.col("text"))).alias("n"))
    rows = got.collect()
    assert all(r.text == r.again for r in rows) and max(r.n for r in rows) > 5


def test_a_clashing_digest_is_told_apart_by_content(spark, odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda c: F.unhex(F.lit("00")))
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len({(r.keep_id, r.group_size, r.text_sha256) for r in found}) == len({r.text_sha256 for r in found})


def test_simhash_against_brute_force(spark):
    base = [sentence(k, 120) for k in range(12)]
    texts = [*base, *[b + " extra" for b in base[:6]], *[b.replace("w1", "v1", 1) for b in base], base[0], "", None, "one", "ONE", "a b c", "  a\tb\nc "]
    docs = spark.createDataFrame([(k * 3 + 1, t) for k, t in enumerate(texts)] + [(1, base[0])], "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()

    def slow(text):
        import xxhash

        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0

    rows = docs.collect()
    fps = [slow(r.text) for r in rows]
    assert sorted((r.doc_id, r.fp % 2**64) for r in found) == sorted((r.doc_id, f) for r, f in zip(rows, fps))
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = union_find(len(fps), pairs)
    smallest = {c: min(rows[k].doc_id for k in range(len(rows)) if comp[k] == c) for c in comp}
    want = {(rows[k].doc_id, smallest[comp[k]]) for k in range(len(rows))}
    assert {(r.doc_id, r.component_id) for r in found} == want
    assert simhash.drop_near_duplicates(docs).count() == len(smallest)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_on_half_the_rows_equal_and_no_ids(spark):
    """A component with half of all rows, null ids, a very long text, clashing names."""
    same, long = sentence(70, 50), sentence(71, 50_000)
    rows = [(k if k % 2 else None, same) for k in range(200)] + [(1000 + k, sentence(6000 + k, 30)) for k in range(198)] + [(None, long), (5000, long + " w1x7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "component": F.lit(1), "first": F.lit(2), "key": F.lit("k"), "text_key": F.lit(0)})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 400 and all(r.component_id == 1 for r in got if r.doc_id is None and r.fp % 2**64 == simhash.fingerprint(same, 4) % 2**64)
    assert {r.component_id for r in got if r.fp == simhash.fingerprint(long, 4)} == {5000}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 200


def test_hamming_balls_find_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for flips in range(1, 7):
            x = int(b) & (2**64 - 1)
            for bit in rng.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    close = np.bitwise_count(u[:, None] ^ u[None]) <= 4
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for cut in simhash.CUTS:
        assert sum(radius + 1 for _, _, radius in cut) > simhash.MAX_BITS and sum(bits for _, bits, _ in cut) == 64
        got = {(r.a, r.b) for r in simhash.near_pairs(table, cut).collect()}
        assert got == {(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(close, 1)))}
    assert simhash.segments_for(10**5) == simhash.CUTS[0] and simhash.segments_for(10**10) == simhash.CUTS[3]


def flipped(rng, base, flips):
    """A fingerprint (signed) with some bits of ``base`` flipped."""
    x = int(base) & (2**64 - 1)
    for bit in rng.choice(64, flips, replace=False):
        x ^= 1 << int(bit)
    return x - 2**64 if x >= 2**63 else x


def test_groups_of_near_fingerprints_make_few_pairs(spark):
    """Two large groups, one of which shares a segment with the other, a chain of steps of four bits, and strangers: the components of
    all pairs, from a small share of them."""
    rng = np.random.default_rng(8)
    one = int(rng.integers(-(2**63), 2**63 - 1, dtype=np.int64))
    two = one ^ (0x5A5A5A << 40)  # the low segments are the same
    fps = {flipped(rng, b, int(rng.integers(0, 5))) for b in (one, two) for _ in range(700)}
    step = one
    for k in range(12):
        step ^= 0b1111 << 4 * k
        fps.add(step)
    fps |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)}
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    pairs = list(zip(*np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 4, 1))))
    comp = union_find(len(fps), pairs)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for cut, full in ((simhash.CUTS[0], 8), (simhash.CUTS[3], simhash.FULL), (simhash.CUTS[0], 0)):
        got = [(r.a, r.b) for r in simhash.near_links(table, cut, full).collect()]
        at = {f: k for k, f in enumerate(fps)}
        assert all((a ^ b).bit_count() <= 4 if a ^ b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in got)
        mine = union_find(len(fps), [(at[a], at[b]) for a, b in got])
        assert len({(comp[k], mine[k]) for k in range(len(fps))}) == len(set(comp[k] for k in range(len(fps)))) == len(set(mine[k] for k in range(len(fps))))
        assert full > 8 or len(got) < len(pairs) / 3, (len(got), len(pairs))


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (200, 200)]
    links = spark.createDataFrame(pairs + [(None, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components.connected_components(links.limit(0)).count() == 0


def test_substrings_go_and_the_rest_stays(spark):
    passage = sentence(99, 80)
    clean = [sentence(k, 200) for k in range(5)]
    texts = {1: clean[0] + " " + passage + " " + clean[1], 2: clean[2] + "\n" + passage + " " + clean[3], 3: clean[4], 4: "", 5: None, 6: "short", 7: "short", 8: passage, 9: "é" * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    assert got[1].text == texts[1] and not got[1].removed
    assert got[3].text == texts[3] and got[4].text == "" and got[5].text is None and got[9].text == texts[9]
    assert got[6].text == "short" and got[7].text == got[8].text == ""
    (span,) = got[2].removed
    assert texts[2][span.start : span.end].strip() == passage and span.first_id == 1
    assert got[2].text == texts[2][: span.start] + texts[2][span.end :]
    assert substring_dedup.clean(docs.limit(0)).count() == 0


def word_runs(text: str, others: list[str], least: int) -> list[tuple[int, int]]:
    """The longest runs of words of a text, ``least`` or more, that stand in one of the others: brute force."""
    words, out, at = text.split(), [], 0
    padded = [f" {' '.join(o.split())} " for o in others]
    while at < len(words):
        end = at
        while end < len(words) and any(f" {' '.join(words[at : end + 1])} " in p for p in padded):
            end += 1
        if end - at >= least:
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_against_brute_force(spark, seed):
    """Passages from 20 to 120 words between random words: those of 51 or more go to a word or two, those below 46 stay."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(letters[x] for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passages = [words(int(n)) for n in rng.integers(20, 121, 40)] + [words(51) for _ in range(20)]
    rows = [(k, f"{words(60)} {passages[k % 60]} {words(60)}") for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    texts, missed = dict(rows), 0
    for d, text in rows:
        runs = word_runs(text, [texts[o] for o in range(d % 60, d, 60)], 50)
        span = [(len(text[: s.start].split()), len(text[: s.end].split())) for s in got[d].removed]
        assert got[d].text.split() == [w for k, w in enumerate(text.split()) if not any(a <= k < b for a, b in span)]
        if not runs:
            assert not span
        elif not span:
            missed += 1
        else:
            assert len(span) == 1 and abs(span[0][0] - runs[0][0]) <= 1 and abs(span[0][1] - runs[0][1]) <= 1, (runs, span)
    assert missed <= 2


def test_substrings_of_repeated_rows_and_rows_without_ids(spark):
    long, passage = sentence(50, 40_000), sentence(51, 70)
    rows = [(None, passage)] * 60 + [(4, passage)] * 3 + [(4, sentence(52, 90) + " " + passage), (None, None), (None, None), (9, long), (10, long + " tail of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "c": F.lit(1), "copies": F.lit(2), "run": F.lit(3), "start": F.lit(4)})
    got = substring_dedup.clean(docs).collect()
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
    # one copy of the passage stays, in one of the rows with the smallest id
    assert sum(passage in (r.text or "") for r in got if len(r.text or "") < 10**5) == 1
    assert {r.doc_id for r in got if passage in (r.text or "")} == {4}
    assert all(r.text == "" and r.removed[0].end == len(passage) for r in got if r.doc_id is None and r.text is not None)
    assert next(r.text for r in got if r.doc_id == 9) == long and next(r.text for r in got if r.doc_id == 10).strip() == "tail of its own"


@pytest.mark.parametrize("copies", [1, 2, 3, 60])
def test_short_phrases_in_repeated_rows_stay(spark, copies):
    """Twelve shared phrases of 14 words with words of their own between: nothing is long enough to go, however often a row repeats."""
    rng = np.random.default_rng(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(letters[x] for x in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n))
    rows = []
    for k in range(6):
        phrases = [words(14) for _ in range(12)]
        a, b = (" ".join(p + " " + words(12) for p in phrases) for _ in range(2))
        rows += [(2 * k, a), *[(2 * k + 1, b)] * copies]
    passage = words(60)
    rows += [(100, f"{words(30)} {passage} {words(30)}"), *[(101, f"{words(30)} {passage} {words(30)}")] * copies]
    texts = dict(rows)
    got = substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for doc_id in texts:
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: -len(r.text))
        assert all(r.text == "" for r in mine[1:])
        if doc_id != 101:
            assert mine[0].text == texts[doc_id] and not word_runs(texts[doc_id], [t for d, t in texts.items() if d < doc_id and d < 100], 50)
        else:
            (span,) = mine[0].removed
            assert texts[101][span.start : span.end].strip() == passage


def test_passages_of_few_cuts_grow_by_whole_chunks(spark):
    """A table of numbers has chunks of up to MAX_CHUNK bytes; its edges go with it."""
    rng = np.random.default_rng(8)
    gear = substring_dedup.gear_table()
    grown = 0
    for k in range(12):
        edge = f" {k % 10}{(k + 3) % 10}" * 300
        passage = f"start{k} {edge} {sentence(300 + k, 60)} {edge} stop{k}"
        a, b = (sentence(int(x), 80) for x in rng.integers(1000, 10**6, 2))
        docs = spark.createDataFrame([(1, a + " " + passage + " " + b), (2, b[::-1] + " " + passage + " " + a[::-1])], "doc_id long, text string")
        text = docs.where("doc_id = 2").first().text
        kept = next(r for r in substring_dedup.clean(docs).collect() if r.doc_id == 2)
        left = sum(len(text[s.start : s.end]) for s in kept.removed)
        ends = substring_dedup.cut_ends(text.encode(), gear)
        grown += max(np.diff([0, *ends])) > substring_dedup.AROUND
        assert left >= len(passage) - 20, (k, left, len(passage))
        if grown >= 3:
            break
    assert grown


def test_gear_hash_and_cuts():
    gear = substring_dedup.gear_table()
    data = sentence(3, 300).encode()
    ends = substring_dedup.cut_ends(data, gear)
    last = 0
    for e in ends[:-1]:
        h = 0
        for b in data[max(0, e - 16) : e]:
            h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        assert h >> 16 < 65536 // substring_dedup.EVERY and e - last >= substring_dedup.MIN_CHUNK
        last = e
    assert ends[-1] == len(data)
    shifted = substring_dedup.cut_ends(b"inserted words here " + data, gear)
    assert len({e - 20 for e in shifted} & set(ends)) > 0.8 * len(ends)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 20)).astype(np.float32)
    x[100:160] = x[:60] + 0.1 * rng.normal(size=(60, 20)).astype(np.float32)
    x[200:240] = x[200]
    rows = [(k + 5, v.tolist()) for k, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 20), (9002, [float("nan")] * 20), (9003, [float("inf")] + [1.0] * 19), (9004, [None] + [1.0] * 19), (9005, []), (9006, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[k + 5].n_links for k in range(600))
    assert 0.9 * close.sum() <= found <= close.sum() and close.sum() > 1600
    comp = union_find(600, list(zip(*np.nonzero(close))))
    assert sum(got[k + 5].component_id == comp[k] + 5 for k in range(600)) >= 590
    for k, _ in odd:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_near_stage_links_five_words_at_point_eight(spark):
    import corpus_pipeline
    from tableloom.llm import near_jaccard

    rng = np.random.default_rng(21)
    texts = []
    for k in range(60):
        words = sentence(1000 + k, 200).split()
        texts.append(" ".join(words))
        for edits in rng.integers(1, 9, 3):
            copy = list(words)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy).upper())
    texts += ["", None, "one two", "ONE two", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(len(sets), pairs)
    shared = spark.sparkContext.broadcast(near_jaccard.shingle_levels(docs))
    marked = near_jaccard.sketches(docs, shared)
    node = {r.doc_id: r.node for r in marked.collect()}
    part = {r.node: r.component for r in near_jaccard.components(docs, marked, shared).collect()}
    got = [part[node[k]] for k in range(len(texts))]
    linked = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 60 and linked == len(pairs)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {k for k in range(len(texts)) if want[k] == k}


def test_near_stage_links_fingerprints_first(spark, monkeypatch):
    """SimHash links near copies, the sets reject what only repeats alike, and linked texts place no shingle in the rest."""
    import corpus_pipeline
    from tableloom.llm import near_jaccard

    rng = np.random.default_rng(41)
    texts = []
    for k in range(40):
        words = sentence(6000 + k, 400).split()
        texts.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            copy[rng.integers(400)] = "changed"
            texts.append(" ".join(copy))
    alike = len(texts)  # fingerprints of what is repeated, sets of what is not
    texts += [f"{'one two three four five six seven ' * 60}{sentence(7000 + k, 30)}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    similar = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    shared = spark.sparkContext.broadcast(near_jaccard.shingle_levels(docs))
    marked = near_jaccard.sketches(docs, shared)
    of = {r.node: r for r in marked.collect()}
    first = F.struct("doc_id", "text_key").alias("first")
    asked = []
    check = near_jaccard.confirmed
    monkeypatch.setattr(near_jaccard, "confirmed", lambda d, n, pairs: asked.append({(of[r.a].doc_id, of[r.b].doc_id) for r in pairs.collect()}) or check(d, n, pairs))
    links = {(of[r.a].doc_id, of[r.b].doc_id) for r in near_jaccard.fingerprint_links(docs, marked.withColumn("first", first)).collect()}
    rows = {r.doc_id: r for r in of.values()}
    close = [(a, b) for a in rows for b in rows if b < a and bin((rows[a].fp ^ rows[b].fp) % 2**64).count("1") <= 4]
    assert any(not similar(a, b) for a, b in asked[0]) and all(similar(a, b) for a, b in links)
    part = union_find(len(texts), list(links))
    assert len(links) > 40 and all(part[a] == part[b] for a, b in close if similar(a, b))
    asked.clear()
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {*range(0, alike, 3), *range(alike, len(texts))}
    assert all(part[a] != part[b] for more in asked[1:] for a, b in more)


def test_near_copies_around_one_text_and_a_passage_of_all(spark, monkeypatch):
    """Copies edited less and more from one text, a passage that a hundred texts share, nulls, repeats and clashing names."""
    from tableloom.llm import near_jaccard

    rng = np.random.default_rng(31)
    base, passage = sentence(2000, 150).split(), sentence(2001, 60)
    texts = [" ".join(base)]
    for _ in range(120):
        copy = list(base)
        for at in rng.choice(150, rng.integers(1, 14), replace=False):
            copy[at] = f"e{rng.integers(10**9)}"
        texts.append(" ".join(copy))
    texts += [f"{sentence(3000 + k, 40)} {passage} {sentence(4000 + k, 40)}" for k in range(100)]
    rows = list(enumerate(texts)) + [(None, texts[5]), (7, texts[7]), (7, texts[130]), (None, None), (None, None), (900, sentence(5000, 9000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "n": F.lit(1), "key": F.lit("k"), "prefix": F.lit(0), "part": F.lit(1)})
    kept = near_jaccard.drop_near_duplicates(docs)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (str(t or "").split() for _, t in rows)]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    want = union_find(len(rows), pairs)
    assert kept.columns == docs.columns and kept.count() == len(set(want))
    by = {r.text: k for k, r in enumerate(docs.collect())}
    assert len({want[by[r.text]] for r in kept.collect()}) == len(set(want))
    assert near_jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("full", [32, 5])
def test_passages_of_few_texts_are_not_carried_through_turns(spark, monkeypatch, full):
    """Pairs of texts that share a passage, and groups of near copies: of buckets of a few texts nothing reaches the turns."""
    from tableloom.llm import near_jaccard

    rng = np.random.default_rng(61)
    texts = [f"{sentence(8000 + k, 100)} {sentence(8500 + k // 2, 9)} {sentence(8600 + k, 60)}" for k in range(80)]
    for k in range(3):
        base = sentence(8800 + k, 150).split()
        for _ in range(20):
            copy = list(base)
            for at in rng.choice(150, rng.integers(1, 12), replace=False):
                copy[at] = f"e{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])])
    carried, crossing = [], near_jaccard.crossing
    monkeypatch.setattr(near_jaccard, "FULL", full, raising=False)
    monkeypatch.setattr(near_jaccard, "crossing", lambda placed: carried.extend(placed.select("key", "node").collect()) or crossing(placed))
    kept = {r.doc_id for r in near_jaccard.drop_near_duplicates(docs).collect()}
    assert kept == {k for k in range(len(texts)) if want[k] == k}
    sizes = {r.key: set() for r in carried}
    for r in carried:
        sizes[r.key].add(r.node)
    assert all(len(nodes) > full for nodes in sizes.values()) and bool(sizes) == (full == 5)


def test_a_large_group_of_near_copies_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_LIST", 20)  # as many lists in the group as a large table has
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] / np.linalg.norm(x[0]) + 0.29 * (noise := rng.normal(size=(500, 32))) / np.linalg.norm(noise, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert want[:500].min() > 100 and sum(got.values()) >= 0.99 * want.sum()
    assert all(got[k] <= want[k] for k in range(1500))


def test_wide_vectors_keep_their_links(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1000, 256))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for a in range(200):
        z = rng.normal(size=256)
        z -= (z @ x[a]) * x[a]
        x[500 + a] = 0.91 * x[a] + np.sqrt(1 - 0.91**2) * z / np.linalg.norm(z)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert sum(got.values()) >= 0.95 * 400


def test_a_full_list_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 16))
    x[:200] = np.linspace(1, 3, 200)[:, None] * x[0]  # copies but for their length, which no clustering splits
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = embedding_dedup.distinct_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    vectors = embedding_dedup.materialize(vectors, "vectors")
    groups = []
    group_by = type(vectors).groupBy

    def watched(self, *keys):
        if keys == ("list", "i", "q", "size"):
            groups.extend(group_by(self, *keys, "kind").count().collect())
        return group_by(self, *keys)

    monkeypatch.setattr(type(vectors), "groupBy", watched)
    found = embedding_dedup.near_links(vectors, 500, 16).collect()
    assert groups and max(r["count"] for r in groups) <= 3 * 32
    name = {r.node: r.first_id for r in vectors.collect()}
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    degree = np.zeros(500, int)
    for r in found:
        if r.other is None:
            degree[name[r.node]] += r.links
        else:
            assert r.links == 0 and close[name[r.node]].any()
    assert (degree == close.sum(1)).all()
    tree = union_find(500, [(name[r.node], name[r.other]) for r in found if r.other is not None])
    assert tree == union_find(500, list(zip(*np.nonzero(close))))


def planted_vectors(n: int, d: int = 64):
    """Random vectors, a twentieth of them partners of others at cosines from 0.90 to 0.95."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, n // 10, 2):
        z = rng.normal(size=d)
        z -= (z @ x[k]) * x[k]
        c = 0.901 + 0.049 * (k / (n // 10))
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    return x, n // 10 // 2 + n // 10 % 2


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_recall_of_planted_pairs(spark, n):
    """At 100 000 vectors the same script finds what README states."""
    x, planted = planted_vectors(n)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    found = sum(got[k].n_links >= 1 and got[k + 1].component_id == got[k].component_id for k in range(0, n // 10, 2))
    assert found >= 0.97 * planted and sum(r.n_links for r in got.values()) <= 2 * planted


def test_repeated_and_missing_vector_ids(spark):
    rng = np.random.default_rng(40)
    a, b = rng.normal(size=12).tolist(), rng.normal(size=12).tolist()
    near = [x + 0.01 for x in a]
    rows = [(3, a), (3, a), (None, near), (7, a), (8, b), (None, b), (9, [1e300] * 12), (10, [1e-300] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit("x"), "component": F.lit(1), "size": F.lit(2), "copies": F.lit("c")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()), key=repr)
    want = [(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (7, 3, 3, False), (8, 1, 8, True), (None, 1, 8, False), (9, 1, 9, True), (10, 1, 9, False)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)]
