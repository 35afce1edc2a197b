"""Line deduplication: of a line that several documents share, only the first document keeps it.

Lines leave their texts at once, as a hash of 128 bits, the document and the position. These records are
partitioned by ranges of (hash, document, position) and sorted within each range, so a hash that a third of
all lines share is spread over as many ranges as its lines need. Each range is streamed once: the first
document of a hash is held, lines of later documents are marked. Where a hash goes on from one range to the
next, the next range can't judge the lines of its own first document; those wait for the edges, one row for
each range, which say who came first. What comes back for a document is a compressed bitmap of the lines
to keep, never its text; documents that keep every line get none.

Defined results: null and empty text are one empty line; a line's key is the line without ASCII white space at
both ends, A-Z lower-cased, and keys of fewer than ``MIN_LENGTH`` code points are never dropped. Rows that share
a doc_id are one document here, each with a bitmap of its own; repeated rows get equal results. A null doc_id comes after all
others, and rows without an id are documents of their own, in the order of a hash of their text, unless their texts are
equal. Repetition inside the document that keeps a line is left alone. Other columns are ignored, whatever their
names; an empty table gives an empty result; texts are read whole, however long.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, bounded_batches, discard, materialize, ship

ship(__name__)
#: A shorter key, in code points, is no line worth dropping.
MIN_LENGTH = 10
#: What names a row: whether it lacks an id, the id (or else a hash of the text), and a hash of the text.
ROW = ["late", "doc", "t"]
MARK = "kind int, h1 long, h2 long, late boolean, doc long, t long, pos int, n_lines int"
DROPPED, WAITS, EDGE = 0, 1, 2


def row_name(doc_id: Column, text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    doc = F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit("no id"), text))
    return [doc_id.isNull().alias("late"), doc.alias("doc"), F.xxhash64(text).alias("t")]


def line_records(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """h1, h2 (the key's hash), ROW, pos, n_lines: one row for each line that may be dropped."""
    bounded_batches(docs.sparkSession)
    names = ["h1", "h2", *ROW, "pos", "n_lines"]

    def run(batches):
        import numpy as np
        from xxhash import xxh3_128_digest

        for batch in batches:
            hashes, at, pos, n_lines = [], [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")  # bytes: A-Z only
                n_lines.append(len(lines))
                for i, line in enumerate(lines):
                    key = line.strip()
                    if len(key) >= min_length and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_length):
                        hashes.append(xxh3_128_digest(key))
                        at.append(k)
                        pos.append(i)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            take, n = pa.array(at, pa.int32()), np.asarray(n_lines, np.int32)[np.asarray(at, np.int32)]
            rows = [batch.column(i).take(take) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *rows, pa.array(pos, pa.int32()), pa.array(n)], names)

    return docs.select(*row_name(F.col("doc_id"), F.col("text")), "text").mapInArrow(run, "h1 long, h2 long, late boolean, doc long, t long, pos int, n_lines int")


def marked(records: DataFrame) -> DataFrame:
    """MARK: the lines to drop, those that wait for an edge, and the last hash of each range with its first document there."""
    order = ["h1", "h2", *ROW, "pos"]
    names = [c.split()[0] for c in MARK.split(", ")]

    def stream(batches):
        import numpy as np

        first = last = held = before = None  # the range's first hash, the last hash seen, its first document, the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, late, doc, t, pos, n_lines = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            again = np.r_[False, (t[1:] == t[:-1]) & (pos[1:] == pos[:-1]) & (doc[1:] == doc[:-1]) & (late[1:] == late[:-1]) & ~new[1:]]
            first = first or (h1[0], h2[0])
            new[0] = (h1[0], h2[0]) != last
            again[0] = (h1[0], h2[0], late[0], doc[0], t[0], pos[0]) == before
            group = np.cumsum(new) - 1  # -1: the hash that the last batch ended with
            starts = np.flatnonzero(new)
            own_late, own_doc = late[starts][group] if len(starts) else late, doc[starts][group] if len(starts) else doc
            if not new[0]:
                own_late, own_doc = np.where(group < 0, held[0], own_late), np.where(group < 0, held[1], own_doc)
            other = (late != own_late) | (doc != own_doc)
            waits = ~other & (h1 == first[0]) & (h2 == first[1])
            take = np.flatnonzero((other | waits) & ~again)
            kind = np.where(waits[take], WAITS, DROPPED).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, *(c[take] for c in (h1, h2, late, doc, t, pos, n_lines)))], names)
            last, held = (h1[-1], h2[-1]), (own_late[-1], own_doc[-1])
            before = (*last, late[-1], doc[-1], t[-1], pos[-1])
        if last:
            row = (EDGE, *last, *held, 0, 0, 0)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x.item() if hasattr(x, "item") else x], k) for x, k in zip(row, kinds)], names)

    return records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, MARK)


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """ROW, n_lines, n_dropped, keep: a compressed bitmap, for the documents that lose lines.

    A document's positions meet as a set, which is gathered before the shuffle and has no more members than it has lines.
    """
    records = materialize(line_records(docs, min_length), "line-records")  # ranges are found by a pass of their own
    marks = materialize(marked(records), "line-marks")
    discard(records)
    edges = marks.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min(F.struct("late", "doc")).alias("first"))
    waiting = marks.where(F.col("kind") == WAITS).join(edges, ["h1", "h2"]).where(F.col("first") < F.struct("late", "doc"))
    gone = marks.where(F.col("kind") == DROPPED).select(*ROW, "n_lines", "pos").unionByName(waiting.select(*ROW, "n_lines", "pos"))
    gone = gone.groupBy(*ROW).agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def pack(batches):
        import numpy as np

        for batch in batches:
            keeps, dropped = [], []
            for n, positions in zip(batch.column(3).to_pylist(), batch.column(4)):
                bits = np.ones(n, np.bool_)
                bits[positions.values.to_numpy()] = False
                keeps.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(len(positions))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())], [*ROW, "n_lines", "n_dropped", "keep"])

    return gone.mapInArrow(pack, "late boolean, doc long, t long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of a text whose bits are set."""
    import numpy as np

    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
    return "\n".join([line for line, bit in zip(lines, bits) if bit])


def drop_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, text (without the lines that go; null as empty), n_lines, n_dropped: one row for each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keeps = materialize(keep_bitmaps(docs, min_length), "keep-bitmaps")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_name(F.col("doc_id"), F.col("text")))
    both = held.join(keeps.drop("n_lines"), ROW, "left")
    lines = F.size(F.split("text", "\n")).cast("long")

    @F.pandas_udf("string")
    def applied(texts, keeps):
        import pandas as pd

        return pd.Series([None if keep is None else kept_lines(text, keep) for text, keep in zip(texts, keeps)], dtype=object)

    # only texts that lose lines go to Python
    short = applied(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep"))
    both = both.select("doc_id", "text", lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), short.alias("short"))
    return both.select("doc_id", F.coalesce("short", "text").alias("text"), "n_lines", "n_dropped")


def op11_line_dedup(spark, sf_dir):
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))



ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.first_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
