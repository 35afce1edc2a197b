"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut where a gear hash over the last 16 bytes falls below a bound, so cuts follow
content and an insertion moves only the chunks it touches. Chunks are named by a 128-bit digest. Of
a chunk found in several documents the smallest doc_id keeps it. Neighbouring chunks that are kept
elsewhere are a run. A run begins and ends at cuts, so the bytes before its first chunk and after its last
one are compared with those in the documents that keep these chunks, and the run grows by what agrees, to
whole words. Spans of ``MIN_WORDS`` words (or ``MIN_BYTES``) or more are removed: long passages go from end
to end, short common phrases and chunks that happen to be equal stay.

Chunks move as digests, never twice to the same group of equal rows; a text moves twice, to give what
stands around kept chunks, and to be cut.

Defined results: null text counts as empty and stays null; empty texts have no chunks; null doc_id is
the largest; of rows that repeat doc_id and text the first counts as the document and the others become
empty; rows that share a doc_id only are documents of their own; repetition inside one document is left
alone; a text that is wholly a copy becomes empty, however short; other columns are ignored; an empty table
gives an empty result. Cuts never split a character.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, ship

ship(__name__)
MIN_CHUNK = 16
MAX_CHUNK = 1024
#: A place is a cut with probability one in so many, past the least chunk.
EVERY = 28
#: Least words, or else bytes, of a span that is removed.
MIN_WORDS, MIN_BYTES = 50, 400
#: Bytes compared before and after a run: so many at least, and the whole neighbouring chunk with MARGIN beyond its cut.
AROUND, MARGIN = 256, 64
GEAR_SEED = 20_240_229


def gear_table():
    import numpy as np

    return np.random.default_rng(GEAR_SEED).integers(0, 2**32, 256, dtype=np.uint32)


def cut_ends(data: bytes, gear) -> list[int]:
    """Where the chunks of a text end, the last one at its length.

    The gear hash h = (h << 1) + gear[byte], kept to its low 16 bits of shifted history, is the sum
    of the last 16 table entries, shifted by their age; doubling the window gives it for all places.
    """
    import numpy as np

    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = gear[raw]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    # the top 16 bits hold all of the window's entries
    hit = (h >> np.uint32(16)) < 65536 // EVERY
    hit[:-1] &= (raw[1:] & 0xC0) != 0x80  # the next byte starts a character
    ends, last = [], 0
    for p in (np.flatnonzero(hit) + 1).tolist():
        while p - last > MAX_CHUNK:
            q = last + MAX_CHUNK
            while q > last + 1 and raw[q] & 0xC0 == 0x80:
                q -= 1
            ends.append(q)
            last = q
        if p - last >= MIN_CHUNK:
            ends.append(p)
            last = p
    while n - last > MAX_CHUNK:
        q = last + MAX_CHUNK
        while q > last + 1 and raw[q] & 0xC0 == 0x80:
            q -= 1
        ends.append(q)
        last = q
    if last < n:
        ends.append(n)
    return ends


def digests(data: bytes, ends: list[int]):
    """The 128-bit digests of the chunks: an array of two signed numbers each."""
    import numpy as np
    from xxhash import xxh3_128_digest

    raw = b"".join([xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends], ends)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def keyed(docs: DataFrame) -> DataFrame:
    """k, c (96 bits of hashes that stand for doc_id and text), doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("k"), F.crc32(F.encode(F.concat_ws("|", F.col("doc_id").cast("string"), text), "UTF-8")).alias("c"),
        F.col("doc_id").cast("long").alias("doc_id"), "text",
    )


def occurrences(rows: DataFrame) -> DataFrame:
    """k, c, doc_id, d1, d2, seq, start, end: every chunk of every document."""
    bounded_batches(rows.sparkSession)
    names = ["k", "c", "doc_id", "d1", "d2", "seq", "start", "end"]

    def run(batches):
        import numpy as np

        gear = gear_table()
        for batch in batches:
            cuts, found = [], []
            for text in batch.column(3).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                cuts.append(cut_ends(data, gear))
                if data:
                    found.append(digests(data, cuts[-1]))
            if not found:
                continue
            n = np.fromiter(map(len, cuts), np.int64, len(cuts))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            end = np.concatenate([np.asarray(x, np.int64) for x in cuts])
            first = np.cumsum(n) - n
            seq = np.arange(len(end)) - np.repeat(first, n)
            start = np.where(seq > 0, np.roll(end, 1), 0)
            d = np.concatenate(found)
            columns = [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), d[:, 0].copy(), d[:, 1].copy(), seq.astype(np.int32), start.astype(np.int32), end.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return rows.mapInArrow(run, "k long, c long, doc_id long, d1 long, d2 long, seq int, start int, end int")


def copied_runs(docs: DataFrame) -> DataFrame:
    """k, c, start, end (bytes), first_id, and the digests and keepers of the first chunk (left) and the last (right):
    the runs of neighbouring chunks that other documents keep.

    Digests are aggregated before the shuffle, so the side joined to has one row for each digest; a hot
    passage on the other side is split by the adaptive skew join.
    """
    rows = keyed(docs)
    shared = occurrences(rows).groupBy("d1", "d2").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high")
    shared = materialize(shared.select("d1", "d2"), "shared-chunks")
    discard()
    found = materialize(occurrences(rows).join(shared, ["d1", "d2"]), "shared-occurrences")
    discard(shared)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k", "c")).alias("first")
    keepers = materialize(found.groupBy("d1", "d2").agg(first), "keepers")
    again = found.join(keepers, ["d1", "d2"]).where("k <> first.k or c <> first.c")
    # equal rows have the same chunks: they meet as a set, before the shuffle where they share a task
    chunks = F.array_sort(F.collect_set(F.struct("seq", "start", "end", "d1", "d2", "first")))
    again = again.groupBy("k", "c").agg(chunks.alias("chunks")).select("k", "c", F.posexplode("chunks").alias("pos", "chunk"))
    again = again.select("k", "c", (F.col("chunk.seq") - F.col("pos")).alias("run"), "chunk.*")
    side = F.struct("d1", "d2", F.col("first.k").alias("k"), F.col("first.c").alias("c"))
    runs = again.groupBy("k", "c", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first.doc_id", "seq").alias("first_id"),
        F.min_by(side, "seq").alias("left"), F.max_by(side, "seq").alias("right"),
    )
    out = materialize(runs.drop("run"), "copied-runs")
    discard(found, keepers)
    return out


def surroundings(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """d1, d2, before, after: what stands around chunks, the neighbouring chunk or AROUND bytes each way, where the document
    that keeps them has them first."""
    asked = runs.select(F.explode(F.array("left", "right")).alias("s")).select("s.*").distinct()
    asked = asked.groupBy("k", "c").agg(F.collect_list(F.struct("d1", "d2")).alias("chunks"))  # no more than the document has
    texts = keyed(docs).join(asked, ["k", "c"]).select("text", F.col("chunks.d1").alias("d1"), F.col("chunks.d2").alias("d2"))
    bounded_batches(docs.sparkSession)

    def run(batches):
        gear = gear_table()
        for batch in batches:
            out = []
            for text, d1, d2 in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode("utf-8", "surrogatepass")
                ends, wanted = cut_ends(data, gear), set(zip(d1, d2))
                around = zip([0, 0, *ends], [0, *ends], ends, [*ends[1:], len(data)], map(tuple, digests(data, ends).tolist()))
                for last, start, end, then, d in around:
                    if d in wanted:
                        wanted.discard(d)
                        out.append((*d, data[max(0, min(last - MARGIN, start - AROUND)) : start], data[end : max(then + MARGIN, end + AROUND)]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 4, kinds)], ["d1", "d2", "before", "after"])

    # repeated rows give the same bytes again
    return texts.mapInArrow(run, "d1 long, d2 long, before binary, after binary").groupBy("d1", "d2").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def common_end(a: bytes, b: bytes) -> int:
    """How many last bytes agree."""
    n = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        n += 1
    return n


def common_start(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


SPACE = b" \t\n\r\x0b\x0c"


def whole_words(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The span cut to whole words, or where a script has no spaces to whole characters."""
    s, e = start, end
    while s < end and s > 0 and data[s - 1] not in SPACE and data[s] not in SPACE:
        s += 1
    while e > s and e < len(data) and data[e] not in SPACE and data[e - 1] not in SPACE:
        e -= 1
    if e - s >= (end - start) // 2:
        return s, e
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def removed_spans(data: bytes, runs: list[tuple]) -> list[tuple]:
    """(start, end, first_id) of what goes, from runs (start, end, first_id, before, after), in bytes."""
    spans: list[list] = []
    for start, end, owner, before, after in sorted(runs, key=lambda r: r[0]):
        before, after = before or b"", after or b""
        start -= common_end(data[max(0, start - len(before)) : start], before)
        end += common_start(data[end : end + len(after)], after)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end, owner])
    out = []
    for start, end, owner in spans:
        if (start, end) != (0, len(data)):
            start, end = whole_words(data, start, end)
            while start < end and data[start] in SPACE:  # it still parts the words around
                start += 1
            if end - start < MIN_BYTES and len(data[start:end].split()) < MIN_WORDS:
                continue
        out.append((start, end, owner))
    return out


SPAN = "array<struct<start:long,end:long,first_id:long>>"


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the removed spans), removed: spans in characters of the old text.

    ``first_id`` is the smallest document that keeps the first chunk of the span.
    """
    runs = copied_runs(docs)
    around = materialize(surroundings(docs, runs), "surroundings")
    discard()
    side = lambda name, column: around.select(F.struct("d1", "d2").alias(f"{name}_chunk"), column)
    near = runs.join(side("left", "before"), F.struct("left.d1", "left.d2") == F.col("left_chunk"), "left")
    near = near.join(side("right", "after"), F.struct("right.d1", "right.d2") == F.col("right_chunk"), "left")
    marks = near.groupBy("k", "c").agg(F.collect_list(F.struct("start", "end", "first_id", "before", "after")).alias("runs"))
    # equal rows are one row until the end: their texts meet before the shuffle
    held = keyed(docs).groupBy("k", "c").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    held = held.join(marks, ["k", "c"], "left")
    held = held.select("doc_id", "text", "copies", *[F.col(f"runs.{c}").alias(c) for c in ("start", "end", "first_id", "before", "after")])
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for text, _, *parts in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                data = text.encode("utf-8", "surrogatepass") if text and parts[0] else b""
                cut = removed_spans(data, list(zip(*parts))) if data else []
                if not cut:
                    texts.append(text)
                    spans.append([])
                    continue
                kept, at, chars, own = [], 0, 0, []
                for s, e, owner in cut:
                    before = data[at:s].decode("utf-8", "surrogatepass")
                    gone = len(data[s:e].decode("utf-8", "surrogatepass"))
                    kept.append(before)
                    own.append({"start": chars + len(before), "end": chars + len(before) + gone, "first_id": owner})
                    chars, at = chars + len(before) + gone, e
                kept.append(data[at:].decode("utf-8", "surrogatepass"))
                texts.append("".join(kept))
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_id", pa.int64())]))
            length = pa.array([len(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind), length, batch.column(2)], ["doc_id", "text", "removed", "chars", "copies"])

    out = held.mapInArrow(run, f"doc_id long, text string, removed {SPAN}, chars long, copies long")
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = (F.col("nth") > 1) & (F.col("chars") > 0)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("chars").alias("end"), F.col("doc_id").alias("first_id")))
    return out.select("doc_id", F.when(again, "").otherwise(F.col("text")).alias("text"), F.when(again, whole).otherwise(F.col("removed")).alias("removed"))


def op2_substring_dedup(spark, sf_dir):
    out = clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", "removed", gone.alias("removed_chars"))
