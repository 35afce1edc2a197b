"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are there.

Features are the runs of one and two words, hashed into ``BUCKETS`` buckets. A task interns the n-grams of a block
of texts in an open-addressed table of numpy arrays: the key is a 64-bit hash, a place is taken by the first n-gram to come,
and what meets a taken place is compared byte for byte before it counts as the same. A slot holds an n-gram's bucket and
count, so a bucket is worked out once for each n-gram of a block. The first pass sums the slots' counts by bucket; what
reaches the driver is ``BUCKETS`` numbers for each side, from which it makes the gains. The second pass lets the slot ids of all
occurrences gather the gains and sums them by document.

A draw without replacement takes the highest sums of weight and Gumbel noise, which is a function of the
doc_id. Ranks come from a sort by ranges: the place within a range plus the rows of the ranges before.

Memory: a block has ``BLOCK`` bytes of text, or one longer word; longer texts are several blocks.

Defined results: null and empty texts have no features, weight 0 and a score like any other, and are never drawn, as they
have too few words; a null doc_id draws the noise of the text 'null' and is the last among ties; rows that share a doc_id
share its noise and are drawn apart; ties beyond the doc_id go by n_features and weight; other columns are ignored,
whatever their names; an empty table gives an empty result, and an empty target gives gains from the documents alone.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship

ship(__name__)
BUCKETS = 10_000
#: Bytes of text whose n-grams share a table.
BLOCK = 250_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Letters (lower-cased if ASCII), digits and all bytes beyond ASCII are words; the rest parts them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def parts(data: bytes, size: int):
    """A folded text in parts of about ``size`` bytes that end between words."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def blocks(texts: list[str | None], size: int = BLOCK):
    """Until all texts are through: (bytes of a block, start and length in it of each n-gram, index of each one's text,
    words of each text in this block).

    In the bytes a space parts words and a line feed parts texts, so an n-gram is a span of them.
    """
    import numpy as np

    held: list[bytes] = []
    runs: list[tuple[int, bool]] = []  # the text of each, and whether it begins with a word that was counted before

    def block():
        data = b"\n".join(held) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw <= 32)
        starts, closes = np.r_[0, ends[:-1] + 1], raw[ends] == 10
        run = np.r_[0, np.cumsum(closes)[:-1]]
        who, again = (np.array(x) for x in zip(*runs))
        single = np.flatnonzero(~(again[run] & np.r_[True, closes[:-1]]))
        pair = np.flatnonzero(~closes)
        at = np.r_[starts[single], starts[pair]]
        words = np.bincount(who[run[single]], minlength=len(texts))
        return data, at, np.r_[ends[single], ends[pair + 1]] - at, who[run[np.r_[single, pair]]], words

    room = size
    for k, text in enumerate(texts):
        last = b""
        for part in parts((text or "").encode("utf-8", "surrogatepass").translate(FOLD), size):
            words = part.split()
            if not words:
                continue
            held.append(b" ".join([last, *words] if last else words))
            runs.append((k, bool(last)))
            last = words[-1]
            room -= len(part)
            if room <= 0:
                yield block()
                held, runs, room = [], [], size
    if runs:
        yield block()


def lanes_of(data: bytes):
    """The eight bytes from each place on, as a little-endian number, zeros after the end."""
    import numpy as np

    return np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))


def xxhash64(data: bytes, lanes, starts, lengths):
    """XXH64 (seed 0) of many spans at once; the few of 32 bytes or more go to the library."""
    import numpy as np
    from xxhash import xxh64_intdigest

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    low = np.uint64(0xFFFFFFFF)

    def turned(x, bits):
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    h, at = lengths.astype(np.uint64) + p5, starts.copy()
    for k in range(3):
        rows = np.flatnonzero(lengths >= 8 * k + 8)
        h[rows] = turned(h[rows] ^ turned(lanes[at[rows]] * p2, 31) * p1, 27) * p1 + p4
        at[rows] += 8
    rows = np.flatnonzero(lengths & 4)
    h[rows] = turned(h[rows] ^ (lanes[at[rows]] & low) * p1, 23) * p2 + p3
    at[rows] += 4
    for k in range(3):
        rows = np.flatnonzero((lengths & 3) > k)
        h[rows] = turned(h[rows] ^ (lanes[at[rows] + k] & np.uint64(255)) * p5, 11) * p1
    for shift, factor in ((33, p2), (29, p3), (32, np.uint64(1))):
        h = (h ^ (h >> np.uint64(shift))) * factor
    for k in np.flatnonzero(lengths >= 32).tolist():
        h[k] = xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return h


def same_bytes(lanes, a, b, n):
    """Whether the spans of lengths ``n`` at ``a`` and at ``b`` agree."""
    import numpy as np

    same, rows, k = np.ones(len(n), np.bool_), np.arange(len(n)), 0
    while len(rows):
        unused = np.maximum(0, 8 * (k + 8 - n[rows])).astype(np.uint64)  # bits of the last eight bytes
        same[rows] &= (lanes[a[rows] + k] ^ lanes[b[rows] + k]) << unused == 0
        k += 8
        rows = rows[n[rows] > k]
    return same


def intern(keys, lanes, starts, lengths):
    """(slot of each n-gram, for each slot the n-gram that took it): equal bytes share a slot, different ones never do.

    The table is at most half full and probed in steps of one. Of those that want a free place the last one takes it.
    """
    import numpy as np

    n = len(keys)
    places = 1 << (2 * n).bit_length()
    table, slot = np.full(places, -1, np.int64), np.empty(n, np.int64)
    todo, at = np.arange(n), (keys & np.uint64(places - 1)).astype(np.int64)
    while len(todo):
        free = table[at] < 0
        table[at[free]] = todo[free]
        owner = table[at]
        same = (keys[todo] == keys[owner]) & (lengths[todo] == lengths[owner])
        asked = np.flatnonzero(same & (todo != owner))
        same[asked] = same_bytes(lanes, starts[todo[asked]], starts[owner[asked]], lengths[todo[asked]])
        slot[todo[same]] = at[same]
        todo, at = todo[~same], (at[~same] + 1) & (places - 1)
    taken = np.flatnonzero(table >= 0)
    owners = table[taken]
    table[taken] = np.arange(len(taken))
    return table[slot], owners


def crc32(data: bytes, starts, lengths):
    """CRC-32 of many spans at once, byte by byte from a table of one-byte remainders; the few beyond 64 bytes go to ``zlib``."""
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    raw, c = np.frombuffer(data, np.uint8), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    rows, k = np.flatnonzero(lengths <= 64), 0
    while len(rows):
        c[rows] = table[(c[rows] ^ raw[starts[rows] + k]) & 255] ^ (c[rows] >> 8)
        k += 1
        rows = rows[lengths[rows] > k]
    c ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths > 64).tolist():
        c[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]])
    return c


def slots(data: bytes, starts, lengths, buckets: int):
    """(slot of each n-gram, bucket of each slot, count of each slot)."""
    import numpy as np

    lanes = lanes_of(data)
    slot, owners = intern(xxhash64(data, lanes, starts, lengths), lanes, starts, lengths)
    bucket = crc32(data, starts[owners], lengths[owners]).astype(np.int64) % buckets
    return slot, bucket, np.bincount(slot, minlength=len(owners))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS):
    """How many features of a table of texts each bucket has: an array of ``buckets`` numbers, whatever the input."""
    import numpy as np

    bounded_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, starts, lengths, _, _ in blocks(batch.column(0).to_pylist()):
                _, bucket, count = slots(data, starts, lengths, buckets)
                np.add.at(total, bucket, count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(documents, target):
    """floor(1000 ln) of a bucket's smoothed share of the target over that of the documents."""
    import numpy as np

    n, s, t = len(documents), documents.astype(np.float64), target.astype(np.float64)
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variate), the same for a doc_id at every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, gains, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain), score: one row for each row of ``docs``."""
    spark, buckets = docs.sparkSession, len(gains)
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(gains)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        import numpy as np

        gains = held.value
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for data, starts, lengths, index, n in blocks(batch.column(1).to_pylist()):
                slot, bucket, _ = slots(data, starts, lengths, buckets)
                words += n
                features += np.bincount(index, minlength=batch.num_rows)
                total += np.bincount(index, weights=gains[bucket][slot], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, total // np.maximum(features, 1)))], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank, from 1 in falling order of score: ranges are sorted apart, and counted to know what comes before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")).drop("at"), "ranges")
    # one row for each range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: ``percent`` of the documents with ``min_words`` words are drawn, the others' rank is null."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialize(scores(docs, gains, seed), "scored")
    may = F.col("n_words") >= min_words
    drawn = percent * scored.where(may).count() // 100
    good = ranked(scored.where(may)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return good.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
words AS (
  SELECT doc_id, src, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text, 0 AS src FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark)),
features AS (
  SELECT doc_id, src, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
known AS (SELECT DISTINCT f FROM features),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM known, crc),
counted AS (SELECT bucket, count(*) FILTER (WHERE src = 0) AS s, count(*) FILTER (WHERE src = 1) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted),
weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE src = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, greatest(0, 2 * len(w) - 1) AS n_features, len(w) AS n_words, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE src = 0),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
