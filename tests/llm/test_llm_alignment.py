"""Token alignment against brute force on the tokenizers themselves."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tableloom.llm import token_alignment
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def sides():
    """Functions from a text to (ids, bytes of each token), by the libraries alone."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def a(text):
        ids = t.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letter[c] for c in t.id_to_token(i)) for i in ids]

    def b(text):
        ids = m.encode(text)
        pieces = [m.id_to_piece(i) for i in ids]
        return ids, [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    return a, b


def brute(rows, sides):
    held = []
    for doc_id, text in rows:
        (a, x), (b, y) = (side(text or "") for side in sides)
        want = (" " + (text or "")).encode()
        if not text or b"".join(x) != want or b"".join(y) != want:
            held.append((doc_id, 0, 0, [], Counter()))
            continue
        ends = [np.cumsum([len(t) for t in z]).tolist() for z in (x, y)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for s in shared:
            groups.append(tuple([i for i, e in zip(ids, es) if last < e <= s] for ids, es in zip((a, b), ends)))
            last = s
        held.append((doc_id, len(a), len(b), groups, Counter((i, j) for g in groups for i in g[0] for j in g[1])))
    count = Counter(p for h in held for p in h[4])
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, n_a, n_b, groups, links in held:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        n_best = sum(m for p, m in links.items() if count[p] == best[p[0]])
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), links.total(), n_best, sum(m * count[p] for p, m in links.items()), digest))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(6)
    words = ["the", "antidisestablishment", "naïve", "日本語", "don't", "x1y2z3", "Ωμέγα", "--", "3.14159", "हिन्दी", "🙂", "\n", "\t", "", "", "fooBarBaz"] + [f"w{k}q" for k in range(40)]
    rows = [(k, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(1, 60)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "▁x is shown as a space"), (504, "<|endoftext|> and <s> are text </s> <unk>"), (505, "nul\0 and \r\n"), (None, rows[3][1]), (3, rows[3][1])]
    return rows + [(506, "a" * 3000 + " " + "日" * 700), (507, "word and more " * 3000), (508, " " * 300 + "x"), (509, "1234567890" * 200)] + [(600 + k, "hot words here") for k in range(60)]


@pytest.mark.parametrize("frequent", [0, 50, 300_000])
def test_against_brute_force(spark, sides, frequent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "pairs", "code", "n_a")})
    got = token_alignment.token_links(docs.repartition(4), max_frequent=frequent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, sides)


def test_empty_table(spark):
    assert token_alignment.token_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = token_alignment.token_links(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in nothing) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_windows_are_remembered_and_cleared(sides, monkeypatch):
    aligner = token_alignment.Aligner(token_alignment.TOKENIZER, token_alignment.RANKS, token_alignment.PIECES)
    texts = [t for _, t in corpus() if t]
    first = aligner.align(texts)
    known = len(aligner.windows.index)
    assert aligner.align(texts) == first and len(aligner.windows.index) == known
    assert known < sum(len(t.split(" ")) for t in texts) / 4
    monkeypatch.setattr(token_alignment, "MAX_REMEMBERED", 10)
    assert [aligner.align([t])[0] for t in texts] == first and len(aligner.windows.index) < known


def test_pairs_are_packed_whole():
    codes, times = np.array([0, 5, 1_607_999_999]), np.array([1, 2**40, 3])
    for n in (1, 3):
        a, b = token_alignment.unpacked(token_alignment.packed(codes[:n], times[:n]))
        assert a.tolist() == codes[:n].tolist() and b.tolist() == times[:n].tolist()


def test_ids_of_a_table(query_sf, sides):
    """The fast encoder gives the ids of the tokenizer on every text of a table."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{query_sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    aligner = token_alignment.Aligner(token_alignment.TOKENIZER, token_alignment.RANKS, token_alignment.PIECES)
    want = aligner.encoder.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [np.frombuffer(aligner.encoder.encode(" " + t), "<u4").tolist() for t in texts] == [w.ids for w in want]
