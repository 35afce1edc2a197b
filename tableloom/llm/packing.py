"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. Only the counts per
length, ``CAPACITY`` numbers at most, reach the driver: best-fit decreasing runs over counts, and
each of its steps is a slot row "ranks r0..r1 of length l go, k to a sequence, into sequences
s0.., at offset o". Pieces then take their slots by joining on length and rank within length; ranks
come from runs whose counts are summed first, so a hot length is never in one task.

Defined results: null text counts as empty and packs as its end token alone; repeated rows pack as
separate documents; null doc_id stays null; other columns are ignored; an empty table gives an
empty result. Every token of every text is packed.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship

ship(__name__)
CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts with characters beyond these, or with special tokens, go to ``tokenizers`` itself.
WIDE = re.compile("[^\u0000-\u024f\u2010-\u2027]")


class Encoder:
    """Texts to little-endian 32-bit ids.

    ``tokenizers`` spends most of its time on objects around the ids, so common texts are encoded
    with the same vocabulary as ranks, which gives the same ids about eight times as fast; tests
    hold the two against each other.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if "<|" not in text and (text.isascii() or not WIDE.search(text)):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _encoder(path: str, ranks: str) -> Encoder:
    """One encoder for each Python worker, whichever task it runs."""
    held = sys.modules.setdefault("tableloom_encoders", types.ModuleType("tableloom_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path, ranks)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and cut: PIECES. The first piece of a longer document is the shorter one."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import public_tokenizers

        encoder = _encoder(public_tokenizers.path(tokenizer), public_tokenizers.path(ranks))
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                at, to, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((doc_id, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, k = to, to + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, r0, r1, per_sequence, s0, offset).

    Sequences with the same room are groups (s0, number). Each length takes whole groups, the
    fullest that still fit first, and splits at most one, so that there are at most three groups for
    each length and a few thousand rows in all, however many documents there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, fresh = [], 0

    def put(free: int, s0: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                bisect.insort(sizes, free)
            room[free].append((s0, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                free = sizes[k]
                s0, n = room[free].pop()
                if not room[free]:
                    del room[free], sizes[k]
            else:
                free, s0 = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            each = free // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, each, s0, capacity - free))
                put(free - each * length, s0, full)
                rank, left, s0, n = rank + full * each, left - full * each, s0 + full, n - full
            if left and n:
                out.append((length, rank, rank + left, left, s0, capacity - free))
                put(free - left * length, s0, 1)
                rank, left, s0, n = rank + left, 0, s0 + 1, n - 1
            put(free, s0, n)
    return out


def ranked(cut: DataFrame) -> DataFrame:
    """Adds rank, gapless from 0 within a length, in the order of (run, doc_id, piece).

    ``run`` is the part that a piece was written in, so a run never grows beyond a task, however many
    rows are equal.
    """
    upto = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("length", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32")
    return (
        cut.withColumn("place", F.row_number().over(within) - 1)
        .join(runs, ["length", "run"])
        .withColumn("rank", F.col("first") + F.col("place"))
        .drop("run", "place", "first")
    )


def slot_table(spark, rows: list[tuple]) -> DataFrame:
    """The rows of :func:`plan` as a table. It goes by Arrow: a list of tuples would be read through an RDD of pickled
    rows, for which every executor starts a second set of Python workers beside those of the SQL operators."""
    columns = zip(*rows) if rows else [()] * 6
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], ["length", "r0", "r1", "each", "s0", "at"]))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: PIECES, sequence_id, offset. The slot table is broadcast: its size is bounded by plan()."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, ranks, capacity, end_id).withColumn("run", F.spark_partition_id()), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slots = slot_table(spark, plan(counts, capacity))
    here = (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))
    place = F.col("rank") - F.col("r0")
    return ranked(cut).join(F.broadcast(slots), "length").where(here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s0") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"),
    )


def op3_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
