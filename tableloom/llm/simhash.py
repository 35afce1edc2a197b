"""SimHash near-duplicates found by multi-index hashing.

A text's fingerprint has a bit for every bit that over half of its shingle hashes set. Equal
fingerprints collapse first; the distinct ones are cut into segments with a radius each, such that two
fingerprints that differ in at most 4 bits differ within the radius in one of the segments at least. A
Hamming ball of that radius is enumerated in each segment; the matches of the segment tables are verified
over all 64 bits, and links are joined to components. Wide segments make more probes and fewer chance
matches, so the cut follows the number of distinct fingerprints (:func:`segments_for`). A segment value that very many
distinct fingerprints share is compared with its middle first; pairs are made between components only (:func:`near_links`).

Defined results: null and empty texts have fingerprint zero and link like any other; null doc_id is
ignored as a component's id unless a component has no other; repeated rows share a fingerprint; texts
are taken whole however long they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep_rows, materialize, row_key, ship
from .components import connected_components

ship(__name__)
MAX_BITS = 4
#: Ways to cut a fingerprint: (lowest bit, bits, radius) of each segment. As the radii and one more for each
#: segment add up to MAX_BITS + 1 or more, no pair is missed.
CUTS = (
    ((0, 23, 1), (23, 23, 1), (46, 18, 0)),
    ((0, 22, 1), (22, 21, 1), (43, 21, 1)),
    ((0, 38, 2), (38, 26, 1)),
    ((0, 32, 2), (32, 32, 2)),
)
SHINGLE = 4
SEED = 42
#: Segment values with more fingerprints than this are compared by stars before pairs.
FULL = 16
#: Stars of a full segment value, at most.
TURNS = 3


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """The hashes of a text's lower-cased shingles; a text of fewer words is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(whole, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return [xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: list[int]) -> int:
    import numpy as np

    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text), fp (signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = [xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - 2**63 for t in texts]
            fps = [fingerprint(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """What to flip in a segment: all sets of at most ``radius`` bits."""
    return [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def segments_for(n: int):
    """The cut that costs least for n distinct fingerprints: its probes, and the chance matches they meet."""
    return min(CUTS, key=lambda cut: sum(math.comb(bits, r) * (1 + n / 2**bits) for _, bits, radius in cut for r in range(radius + 1)))


def around(key, flips: list[int]):
    """An array of the keys that ``flips`` make of one."""
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: key.bitwiseXOR(x))


def keyed(fps: DataFrame, segments) -> tuple[DataFrame, DataFrame]:
    """(b, key: the segment tables; a, key: what every fingerprint probes there)."""
    held, probed = [], []
    for k, (low, bits, radius) in enumerate(segments):
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(k << 40))
        held.append(own)
        probed.append(around(own, ball(bits, radius)))
    tables = fps.select(F.col("fp").alias("b"), F.explode(F.array(*held)).alias("key"))
    return tables, fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probed))).alias("key"))


def close(a, b):
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def near_pairs(fps: DataFrame, segments=CUTS[0]) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp) that differ in at most MAX_BITS bits."""
    tables, probes = keyed(fps, segments)
    return probes.join(tables, "key").where((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b"))).select("a", "b").distinct()


def stars(placed: DataFrame) -> DataFrame:
    """a, b: links of the fingerprints of a segment value (``placed``: key, fp, part) to one that stands in the middle of
    those that are not in its main part: the one that differs least from their majority of bits."""
    main = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
    apart = placed.join(materialize(main.where("parts > 1"), "main-parts"), "key").where("part <> main OR most = 1")
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"bit{i}") for i in range(64)]
    sums = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *bits)
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.shiftleft((F.col(f"bit{i}") * 2 > F.col("n")).cast("long"), i))
    middles = materialize(sums.select("key", middle.alias("middle")), "middles")
    off = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))), "fp")
    heads = apart.join(middles, "key").groupBy("key").agg(F.min_by(F.struct("fp", "part"), off).alias("head"))
    near = placed.join(materialize(heads, "segment-heads"), "key").where((F.col("part") != F.col("head.part")) & close(F.col("fp"), F.col("head.fp")))
    return near.select(F.col("head.fp").alias("a"), F.col("fp").alias("b")).distinct()


def near_links(fps: DataFrame, segments=CUTS[0], full: int = FULL) -> DataFrame:
    """a, b: links between fingerprints that differ in at most MAX_BITS bits, enough to make the components of them all.

    Segment values of at most ``full`` fingerprints are probed for all pairs. Fuller ones, where a large group of
    near copies stands, first get TURNS of stars; only pairs of fingerprints that these leave in different components are
    made there, so a group does not make all its pairs, and no pair that joins components is left out.
    """
    tables, probes = keyed(fps, segments)
    hot = materialize(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > full).select("key"), "full-segments")
    if hot.isEmpty():
        return near_pairs(fps, segments)
    own = materialize(tables.join(hot, "key").select("key", F.col("b").alias("fp")), "full-rows")
    links = parts = None
    placed = own.withColumn("part", F.col("fp"))
    for _ in range(TURNS):
        found = materialize(stars(placed), "stars")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        parts = materialize(connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("part")), "star-parts")
        placed = materialize(own.join(parts, "fp", "left").select("key", "fp", F.coalesce("part", "fp").alias("part")), "full-rows")
    main = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    main = materialize(main, "main-parts")
    asked = probes.join(main, "key")
    if parts is not None:
        asked = asked.join(parts.select(F.col("fp").alias("a"), F.col("part").alias("of_a")), "a", "left")
    asked = asked.withColumn("of_a", F.coalesce("of_a", "a") if parts is not None else F.col("a"))
    held = placed.select("key", F.col("fp").alias("b"), F.col("part").alias("of_b"))
    aside = held.join(main, "key").where("of_b <> main").drop("main")
    fit = (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & close(F.col("a"), F.col("b"))
    # those of the main part meet what is not of it only, so no two of its fingerprints are paired
    crossing = [asked.where("of_a = main").join(aside, "key").where(fit), asked.where("of_a <> main").join(held, "key").where(fit)]
    few = probes.join(hot, "key", "left_anti").join(tables, "key").where((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b")))
    out = few.select("a", "b")
    for more in [*crossing, *([links] if links is not None else [])]:
        out = out.unionByName(more.select("a", "b"))
    return out.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_key, fp, component_id (smallest doc_id), first_key.

    ``first_key`` is the smallest text_key among the rows of the component with that doc_id.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first")
    distinct = materialize(marked.groupBy("fp").agg(first), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), segments_for(distinct.count()))
    parts = connected_components(links).select(F.col("node").alias("fp"), "component")
    placed = materialize(distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "fingerprint-parts")
    # the heads are a table of their own, so that the join back can split a component that holds much
    heads = materialize(placed.groupBy("component").agg(F.min("first").alias("head")), "component-heads")
    placed = placed.join(heads, "component").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.text_key").alias("first_key"))
    placed = materialize(placed, "placed")
    return marked.join(placed, "fp").select("doc_id", "text_key", "fp", "component_id", "first_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: its smallest doc_id."""
    import xxhash  # noqa: F401  the key below equals the one of fingerprints()

    found = near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    return keep_rows(docs, text_key(), kept.select(row_key(F.col("doc_id"), F.col("text_key")).alias("key")).distinct())


def text_key():
    """text_key of a row's text, as fingerprints() gives it."""
    @F.pandas_udf("long")
    def key(texts):
        from xxhash import xxh64_intdigest

        return texts.map(lambda t: xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - 2**63)

    return key(F.col("text"))


def op7_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
