"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids meet in a corpus.

Every text is tokenised whole by both. A place where a token of each begins with a space is an anchor: the tokens before it
end together, so it splits the text into windows, about a word each. A window is a pair of id tuples; its groups (cut
where tokens of both end), the pairs of ids that share a group and their text are worked out once for each pair of
tuples and remembered. What a text keeps is its numbers, a digest of its groups and its distinct id pairs, delta-coded and
compressed; texts are read once, and only these rows are read again.

Pairs are counted in tasks before the shuffle. ``MAX_FREQUENT`` of them at most, the most frequent by a threshold that a
histogram gives, are sent to all tasks with the highest count of each id of A (as many numbers as it has ids); the
rest, each of which few documents hold, meet their counts in a join. Every pair is counted, and no text is cut.

Memory: a block has ``BLOCK`` bytes of texts or one longer text; the memory of windows is cleared beyond ``MAX_REMEMBERED``
pairs. In a group of many tokens ids are counted before they are paired.

Defined results: null and empty texts, and those that one of the tokenizers does not give back byte for byte, have no tokens:
zeros and an empty text for the digest; special tokens in a text are plain text; rows that repeat a doc_id or a text
are documents of their own; null doc_id stays null; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import sys
import types
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, ship
from .packing import RANKS, TOKENIZER, Encoder

ship(__name__)
PIECES = "piece_bpe_32k.model"
BLOCK = 2_000_000
#: Id pairs of remembered windows in a worker, and pairs that a task counts before it hands them on.
MAX_REMEMBERED, MAX_COUNTED = 2_000_000, 4_000_000
#: Pairs whose counts are sent to all tasks: 16 bytes each.
MAX_FREQUENT = 300_000
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


class Windows:
    """Windows by their id tuples: groups, links, the groups' text, and the id pairs with their numbers of links."""

    def __init__(self, lengths_a: list[int], lengths_b: list[int]):
        self.lengths = lengths_a, lengths_b
        self.names = list(map(str, range(max(len(lengths_a), len(lengths_b)))))
        self.clear()

    def clear(self) -> None:
        self.index: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.groups, self.links, self.codes, self.times, self.ends = (array("q") for _ in range(5))
        self.ends.append(0)

    def add(self, key: tuple[bytes, bytes]) -> int:
        """Cut a window where tokens of both sides end, and pair the ids of each group."""
        lengths_a, lengths_b = self.lengths
        size_b, names = len(lengths_b), self.names
        a, b = array("H", key[0]), array("H", key[1])
        links: dict[int, int] = {}
        texts, n_links, i, j, k, end_a, end_b = [], 0, 0, 0, 0, 0, 0
        for n, token in enumerate(a, 1):
            end_a += lengths_a[token]
            while end_b < end_a:
                end_b += lengths_b[b[k]]
                k += 1
            if end_a != end_b:
                continue
            left, right = a[i:n], b[j:k]
            texts.append(",".join([names[x] for x in left]) + "|" + ",".join([names[y] for y in right]))
            n_links += len(left) * len(right)
            if len(left) * len(right) <= 64:
                for x in left:
                    for y in right:
                        code = x * size_b + y
                        links[code] = links.get(code, 0) + 1
            else:
                times = Counter(right).items()
                for x, m in Counter(left).items():
                    for y, r in times:
                        code = x * size_b + y
                        links[code] = links.get(code, 0) + m * r
            i, j = n, k
        self.groups.append(len(texts))
        self.links.append(n_links)
        self.texts.append(";".join(texts))
        self.codes.extend(links)
        self.times.extend(links.values())
        self.ends.append(len(self.codes))
        self.index[key] = known = len(self.groups) - 1
        return known


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the windows met so far."""

    def __init__(self, tokenizer: str, ranks: str, pieces: str):
        import numpy as np
        import public_tokenizers
        import sentencepiece

        self.encoder = Encoder(public_tokenizers.path(tokenizer), public_tokenizers.path(ranks))
        self.encoder.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        vocabulary = self.encoder.fast.__self__
        self.bytes_a = [vocabulary.decode_single_token_bytes(k) for k in range(vocabulary.n_vocab)]
        named = [(self.model.is_byte(k), self.model.id_to_piece(k)) for k in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for byte, p in named]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.marked_a, self.marked_b = (np.array([x.startswith(b" ") for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.spelled_a, self.spelled_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        self.windows = Windows(self.lengths_a.tolist(), self.lengths_b.tolist())

    def tokens(self, texts: list[str]):
        """The ids of both sides of each text, and whether both give its bytes after a space."""
        import numpy as np

        a = [np.frombuffer(self.encoder.encode(" " + x), "<u4") for x in texts]
        b = [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]
        want = [b" " + x.encode("utf-8", "surrogatepass") for x in texts]
        good = np.fromiter(map(bool, texts), np.bool_, len(texts))
        for ids, lengths, spelled in ((a, self.lengths_a, self.spelled_a), (b, self.lengths_b, self.spelled_b)):
            good &= np.fromiter((lengths[x].sum() for x in ids), np.int64, len(ids)) == np.fromiter(map(len, want), np.int64, len(want))
            some = np.flatnonzero(good).tolist()
            if not some:
                break
            first = np.cumsum(lengths) - lengths
            flat = np.concatenate([ids[k] for k in some])
            sizes = lengths[flat]
            place = np.arange(sizes.sum()) + np.repeat(first[flat] - np.cumsum(sizes) + sizes, sizes)
            differs = spelled[place] != np.frombuffer(b"".join([want[k] for k in some]), np.uint8)
            ends = np.cumsum([len(want[k]) for k in some])
            good[np.array(some)[np.searchsorted(ends, np.flatnonzero(differs), "right")]] = False
        return a, b, good.tolist()

    def align(self, texts: list[str]):
        """For each text: (n_a, n_b, n_groups, n_links, digest, pairs), or None."""
        import numpy as np

        all_a, all_b, good = self.tokens(texts)
        some = [k for k, x in enumerate(good) if x]
        if not some:
            return [None] * len(texts)
        if len(self.windows.codes) > MAX_REMEMBERED:
            self.windows.clear()
        a, b = (np.concatenate([x[k] for k in some]).astype(np.int64) for x in (all_a, all_b))
        at_a, at_b = (np.cumsum(n[x]) - n[x] for n, x in ((self.lengths_a, a), (self.lengths_b, b)))
        first = np.cumsum([0] + [len(all_a[k]) for k in some])  # of each text, in a
        # anchors: both sides begin a token with a space; a text's first tokens always do
        begins = np.zeros(int(at_a[-1]) + len(self.bytes_a[a[-1]]), np.bool_)
        begins[at_b[self.marked_b[b]]] = True
        from_a = np.flatnonzero(self.marked_a[a] & begins[at_a])
        from_b = np.searchsorted(at_b, at_a[from_a])
        ids = self.ids(a, b, from_a, from_b)
        who = np.searchsorted(first, from_a, "right") - 1
        w, n = self.windows, len(some)
        groups, links = (np.array(x, np.int64)[ids] for x in (w.groups, w.links))
        cuts = np.searchsorted(who, np.arange(n + 1))
        total = lambda x: np.diff(np.r_[0, np.cumsum(x)][cuts])
        words = list(map(w.texts.__getitem__, ids.tolist()))
        digests = [hashlib.sha256(";".join(words[i:j]).encode()).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        out = iter(zip((len(all_a[k]) for k in some), (len(all_b[k]) for k in some), total(groups).tolist(), total(links).tolist(), digests, self.pairs(who, ids, n)))
        return [next(out) if x else None for x in good]

    def ids(self, a, b, from_a, from_b):
        """The window at each anchor. Windows that occur again in the block are found by a hash and compared, so each
        pair of tuples is looked up once."""
        import numpy as np

        raw_a, raw_b = a.astype(np.uint16).tobytes(), b.astype(np.uint16).tobytes()
        index, add, n = self.windows.index, self.windows.add, len(from_a)
        sides = [(x, start, np.diff(np.r_[start, len(x)])) for x, start in ((a, from_a), (b, from_b))]
        mixed = np.zeros(n, np.uint64)
        for x, start, size in sides:
            place = np.arange(len(x)) - np.repeat(start, size)
            h = (x.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(20)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = mixed * np.uint64(3) + np.add.reduceat(h ^ (h >> np.uint64(32)), start)
        _, first, again = np.unique(mixed, return_index=True, return_inverse=True)
        like = first[again]
        odd = np.zeros(n, np.bool_)
        for _, _, size in sides:
            odd |= size != size[like]
        like[odd] = np.flatnonzero(odd)
        for x, start, size in sides:
            differs = x != x[np.arange(len(x)) + np.repeat(start[like] - start, size)]
            odd |= np.logical_or.reduceat(differs, start)

        def looked_up(rows):
            out = []
            spans = [y[rows].tolist() for _, start, size in sides for y in (2 * start, 2 * (start + size))]
            for i, j, k, m in zip(*spans):
                key = raw_a[i:j], raw_b[k:m]
                known = index.get(key)
                out.append(add(key) if known is None else known)
            return np.array(out, np.int64)

        out = looked_up(first)[again]
        if odd.any():  # two windows with one hash
            out[odd] = looked_up(np.flatnonzero(odd))
        return out

    def pairs(self, who, ids, n: int) -> list[bytes]:
        """Each text's distinct id pairs and their numbers of links, packed."""
        import numpy as np

        w = self.windows
        ends, codes, times = (np.array(x, np.int64) for x in (w.ends, w.codes, w.times))
        key, seen = np.unique(who * len(w.groups) + ids, return_counts=True)
        text, ids = np.divmod(key, len(w.groups))
        sizes = ends[ids + 1] - ends[ids]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[ids], sizes)
        key = np.repeat(text << 32, sizes) | codes[place]
        order = np.argsort(key, kind="stable")
        key, many = key[order], (np.repeat(seen, sizes) * times[place])[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, many = key[starts], np.add.reduceat(many, starts)
        cuts = np.searchsorted(key, np.arange(n + 1) << 32)
        return [packed(key[i:j] & 0xFFFFFFFF, many[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def packed(codes, times) -> bytes:
    """Rising codes as differences, numbers of links as they are (32 bits where that does), equal bytes of each side by side."""
    import numpy as np
    import zstandard

    wide = np.uint32 if not len(times) or times.max() < 2**32 else np.uint64
    halves = np.diff(codes, prepend=0).astype(np.uint32), times.astype(wide)
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in halves)
    return len(codes).to_bytes(4, "little") + zstandard.compress(planes, 3)


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    n, planes = int.from_bytes(data[:4], "little"), np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    codes, times = (x.reshape(-1, n).T.copy() for x in (planes[: 4 * n], planes[4 * n :]))
    return np.cumsum(codes.view(np.uint32).ravel().astype(np.int64)), times.view(np.uint32 if times.shape[1] == 4 else np.uint64).ravel().astype(np.int64)


def _aligner(*paths: str) -> Aligner:
    """One for each Python worker, whichever task it runs."""
    held = sys.modules.setdefault("tableloom_aligners", types.ModuleType("tableloom_aligners")).__dict__
    if paths not in held:
        held[paths] = Aligner(*paths)
    return held[paths]


def aligned(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """ALIGNED: one row for each row of ``docs``; ``row`` numbers them. Pairs are null where there are no tokens."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = (*[pa.int64()] * 6, pa.string(), pa.binary())

    def run(batches):
        aligner = _aligner(tokenizer, ranks, pieces)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < BLOCK):
                    size += len(texts[to])
                    to += 1
                rows = [x or (0, 0, 0, 0, "", None) for x in aligner.align(texts[at:to])]
                keys = [batch.column(i).slice(at, to - at) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[2:]))], names)
                at = to

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """code, n: how many documents hold each id pair. A task hands on each pair once for every MAX_COUNTED it has read."""

    def run(batches):
        import numpy as np

        held, size = [], 0

        def counted():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(unpacked(data)[0])
                size += len(held[-1])
                if size >= MAX_COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return rows.where("pairs is not null").select("pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least count of which all pairs with it or more are ``most`` at most. The histogram has eight steps for each power of two."""
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy(F.desc("step")).collect():
        if row.pairs > left:
            return row.high + 1
        left, least = left - row.pairs, row.low
    return least or 0


def token_links(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, pieces: str = PIECES, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    n_best: links whose count is the highest that their id of A has; count_sum: the sum of the links' counts.
    """
    import numpy as np
    import public_tokenizers
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces)).get_piece_size()
    rows = materialize(aligned(docs, tokenizer, ranks, pieces), "aligned")
    discard()
    counts = materialize(pair_counts(rows), "pair-counts")
    highest = counts.groupBy(F.floor(F.col("code") / size_b).alias("a")).agg(F.max("n").alias("n")).collect()  # a row for each id of A
    best = np.zeros(max((r.a for r in highest), default=0) + 1, np.int64)
    for r in highest:
        best[r.a] = r.n
    least = least_frequent(counts, max_frequent)
    known = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(known["code"].to_numpy())
    held = spark.sparkContext.broadcast((known["code"].to_numpy()[order], known["n"].to_numpy()[order], best))
    all_known = counts.where(F.col("n") < least).isEmpty()

    def looked_up(codes):
        """Where each code is among the frequent ones, and whether it is."""
        at = np.minimum(np.searchsorted(held.value[0], codes), max(0, len(held.value[0]) - 1))
        return at, held.value[0][at] == codes if len(held.value[0]) else np.zeros(len(codes), np.bool_)

    def sums(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                if data is None:
                    out.append((0, 0))
                    continue
                codes, times = unpacked(data)
                at, there = looked_up(codes)
                n, codes, times = held.value[1][at[there]], codes[there], times[there]
                out.append((int((times * n).sum()), int(times[held.value[2][codes // size_b] == n].sum())))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "count_sum", "n_best"])

    kept = [c for c in ALIGNED.split(", ") if not c.startswith("pairs")]
    done = rows.select("pairs", *[c.split()[0] for c in kept]).mapInArrow(sums, ", ".join([*kept, "count_sum long", "n_best long"]))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if all_known:
        return done.select(*columns)

    def rest(batches):
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, times = unpacked(data)
                codes, times = (x[~looked_up(codes)[1]] for x in (codes, times))
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row)), pa.array(codes), pa.array(times)], ["row", "code", "times"])

    rare = rows.where("pairs is not null").select("row", "pairs").mapInArrow(rest, "row long, code long, times long")
    tops = spark.createDataFrame([(r.a, r.n) for r in highest], "a long, top long")
    few = counts.where(F.col("n") < least).join(F.broadcast(tops), F.floor(F.col("code") / size_b) == F.col("a"))
    few = few.select("code", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    more = rare.join(few, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.col("times") * F.col("is_best")).alias("b"))
    both = done.join(more, "row", "left")
    both = both.withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0)))
    return both.select(*columns)


def op12_token_alignment(spark, sf_dir):
    return token_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
