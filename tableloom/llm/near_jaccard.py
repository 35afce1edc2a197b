"""Near-duplicate documents: SimHash links, an exact check of them, and an exact way for the rest.

Two texts are near duplicates if their sets of lower-cased shingles of ``SHINGLE`` words have a
Jaccard similarity of at least ``THRESHOLD``. SimHash comes first: fingerprints of these shingles are linked by
multi-index hashing (:func:`simhash.near_links`), and each link is kept if the sets of its texts confirm it.

Fingerprints miss links: at 0.8 two of them differ in about 10 of 64 bits, up to 18, and balls of that radius
hold a fixed share of all pairs. What they leave in different components is therefore linked by prefix filtering,
which misses none: with the shingles of each set in one global order, two sets of n shingles can only reach the
similarity t if they share one of their first n - ceil(t n) + 1. The order puts rare shingles first, by a hashed
table of counts of bounded size, so a passage that many documents share proposes nothing. Shingles that only
texts of one component share are left out, before anything of them is kept.

Equal sets collapse first. A shingle that few texts share is settled by its pairs that can be similar, at once. The
texts of a fuller one are compared with one of them, at each turn another; only those that are then still in different
components are compared pair by pair, so a large group of near copies seldom makes all its pairs, and no pair that could
join two components is left out.

Defined results: null and empty texts have the empty set and are equal; a text of fewer words is one
shingle; null doc_id is kept only of a component that has no other; repeated rows count once; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, keep_rows, materialize, row_key, ship
from .components import connected_components
from .simhash import fingerprint_of, near_links, segments_for, shingle_hashes

ship(__name__)
SHINGLE = 5
THRESHOLD = 0.8
#: Cells of the table of counts, moved and added in BLOCKS parts.
CELLS, BLOCKS = 1 << 20, 64
#: Keys of at most so many texts, which are counted, are broadcast: about 50 MB.
FEW_NODES = 1_000_000
#: Turns of comparing buckets with a head, at most, before all their pairs.
TURNS = 3
#: Shingles of at most so many texts are settled first, by all their pairs that can be similar.
FULL = 32


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_set(text: str | None):
    """The distinct shingle hashes of a text, in order."""
    import numpy as np

    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def set_key(held) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(held.tobytes()) - 2**63


def shingle_levels(docs: DataFrame):
    """How frequent shingles are, by cells of their hashes: quarter octaves of the documents that have them.

    CELLS numbers whatever the corpus. Tasks' tables are added in two rounds, so that no group grows with
    the number of tasks.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)

    def run(batches):
        n = np.zeros(CELLS, np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(n, (shingle_set(text) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        parts = [x.tobytes() if n.any() else b"" for x in np.split(n, BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "n"])

    def add(group):
        total = np.zeros(CELLS // BLOCKS, np.int64)
        for x in group.column("n").to_pylist():  # a task's counts are 32 bits wide, sums 64
            total += np.frombuffer(x, np.int32 if len(x) == 4 * len(total) else np.int64) if x else 0
        return pa.table([group.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["block", "n"])

    sums = docs.select("text").mapInArrow(run, "block int, n binary").withColumn("part", F.spark_partition_id() % 256)
    for keys in (["block", "part"], ["block"]):
        sums = sums.groupBy(*keys).applyInArrow(lambda key, group: add(group), "block int, n binary").withColumn("part", F.lit(0))
    n = np.zeros(CELLS, np.int64).reshape(BLOCKS, -1)
    for block, mass, _ in sums.collect():
        n[block] = np.frombuffer(mass, np.int64)
    return (4 * np.log2(1 + n.ravel())).astype(np.uint8)


def prefix(held, levels):
    """The first shingles of a set in the global order, one of which every similar set shares; 0 of the empty set."""
    import numpy as np

    n = len(held)
    if not n:
        return np.zeros(1, np.int64)
    order = np.argsort(levels[(held & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")  # then by hash, as they stand
    return held[order[: n - math.ceil(THRESHOLD * n - 1e-9) + 1]].view(np.int64)


def usualness(held, levels) -> int:
    """The mean level of a set's shingles. Of a group of near copies the text that all come from has the most."""
    import numpy as np

    return int(1000 * levels[(held & np.uint64(CELLS - 1)).astype(np.int64)].mean()) if len(held) else 0


def sketches(docs: DataFrame, shared) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), n (its size), usual (how frequent its shingles are),
    fp (the SimHash fingerprint), prefix (the shingles of :func:`prefix` as bytes)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import numpy as np

        levels = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(2):  # text by text: the hashes of a whole batch would be some hundred bytes a word
                hashes = shingle_hashes(text.as_py(), SHINGLE)
                held = np.unique(np.array(hashes, np.uint64))
                rows.append((set_key(held), len(held), usualness(held, levels), fingerprint_of(hashes), prefix(held, levels).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "node", "n", "usual", "fp", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, n int, usual int, fp long, prefix binary")


def prefixes(nodes: DataFrame, with_part: bool) -> DataFrame:
    """key and part, or key, node and at (its place): the prefix shingles of ``nodes``."""

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in texts], np.int64)
            keys = np.frombuffer(b"".join(texts), np.int64)
            columns = [keys, np.repeat(batch.column(0).to_numpy(), sizes)]
            if not with_part:
                columns.append((np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part"] if with_part else ["key", "node", "at"])

    rows = nodes.select("part" if with_part else "node", "prefix")
    return rows.mapInArrow(run, "key long, part long" if with_part else "key long, node long, at int")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, held (the sorted hashes as bytes) of the documents named in ``wanted`` (column key).

    Where they are counted to be few, their keys are broadcast and no text is shuffled.
    """
    wanted = materialize(wanted, "wanted")
    few = wanted.count() <= FEW_NODES

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "held"]
            )

    texts = docs.select("text", row_key(F.col("doc_id").cast("long"), text_key()).alias("key"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    return texts.select("text").mapInArrow(run, "node long, held binary").dropDuplicates(["node"])  # repeated rows


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity THRESHOLD."""

    def run(batches):
        import numpy as np

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= THRESHOLD * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # pairs are few beside texts, and a set moves once for its pairs as b and once for each as a
    one = sets.select(F.col("node").alias("a"), F.col("held").alias("held_a"))
    two = sets.select(F.col("node").alias("b"), F.col("held").alias("held_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "held_a", "held_b").mapInArrow(run, "a long, b long")


def crossing(placed: DataFrame) -> DataFrame:
    """key, rows, pairs, main, least: the shingles that texts of more than one component share, their pairs
    between components, the component with the most texts and the size of the smallest set."""
    parts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    sums = parts.groupBy("key").agg(
        F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count(F.lit(1)).alias("parts"),
        F.max_by("part", F.struct("k", "part")).alias("main"), F.min("n").alias("least"),
    )
    pairs = ((F.col("rows") * F.col("rows") - F.col("squares")) / 2).cast("long")
    return sums.where("parts > 1").select("key", "rows", pairs.alias("pairs"), "main", "least")


def fits(n, at, other):
    """Whether a set of n shingles whose first common one stands ``at`` places in can be similar to one of size ``other``.

    It shares n - at at most, and needs THRESHOLD / (1 + THRESHOLD) of both sizes. Of all common shingles the first
    one judges right, so a pair that is similar is let through there.
    """
    return n - at >= (n + other) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9


def both_fit(a: str, b: str):
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return fits(n, F.col(f"{a}at"), m) & fits(m, F.col(f"{b}at"), n)


def star_pairs(placed: DataFrame, mixed: DataFrame, turn: int) -> DataFrame:
    """a, b: every text of a mixed bucket with one of the bucket's, the most usual one of a hashed half of them.

    Each turn has another half (the first one has all), so a bucket is compared with several of its most usual texts.
    """
    own = placed.join(mixed.select("key"), "key", "left_semi")
    late = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) if turn else F.lit(0)
    pick = F.min_by(F.struct("node", "n", "at", "part"), F.struct(late.alias("late"), -F.col("usual"), "node")).alias("head")
    heads = materialize(own.groupBy("key").agg(pick), "bucket-heads")
    pairs = own.join(heads, "key").where((F.col("part") != F.col("head.part")) & both_fit("", "head."))
    return pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def all_pairs(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """a, b: the pairs of a bucket between components that can be similar. One side leaves out the main component
    and what is too far in to be similar to the smallest set there."""
    own = placed.join(mixed.select("key", "main", "least"), "key").where(fits(F.col("n"), F.col("at"), F.greatest(F.col("least"), F.col("n") * THRESHOLD)))
    side = lambda x: F.struct("node", "n", "at", "part").alias(x)
    left, right = own.where("part <> main").select("key", "main", side("x")), own.select("key", side("y"))
    once = (F.col("y.part") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    pairs = left.join(right, "key").where((F.col("x.part") != F.col("y.part")) & once & both_fit("x.", "y."))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def few_pairs(placed: DataFrame) -> DataFrame:
    """a, b: the pairs of buckets of at most FULL texts between components that can be similar.

    Most shingles that two prefixes share by chance stand too far in, or in sets of too different sizes, so these pairs
    are fewer than the rows, and never more than FULL / 2 times as many.
    """
    side = lambda x: placed.where(F.col("rows") <= FULL).select("key", F.struct("node", "n", "at", "part").alias(x))
    fit = (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & both_fit("x.", "y.")
    return side("x").join(side("y"), "key").where(fit).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def confirmed(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of ``asked`` (a, b) whose shingle sets are similar."""
    ends = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select(row_key(F.col("first.doc_id"), F.col("first.text_key")).alias("key"))
    sets = materialize(shingle_sets(docs, wanted), "shingle-sets")
    links = materialize(verified(asked, sets), "verified-pairs")
    discard(sets)
    return links


def fingerprint_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the links between ``nodes`` that SimHash proposes and the shingle sets confirm."""
    distinct = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "distinct-fingerprints")
    near = near_links(distinct.select("fp"), segments_for(distinct.count()))
    one, two = (distinct.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
    near = near.join(one, "a").join(two, "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    equal = nodes.select("fp", "node").join(distinct, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    asked = materialize(near.unionByName(equal), "fingerprint-pairs")
    links = confirmed(docs, nodes, asked)
    discard(asked)
    return links


def components(docs: DataFrame, marked: DataFrame, shared) -> DataFrame:
    """node, component, first (doc_id and text_key of the node) for every node of ``marked``.

    SimHash links make the first components. Shingles of at most FULL texts are settled at once: of their pairs those
    that can be similar are verified, so what is shared by chance is never carried on. Fuller ones get turns of star
    pairs, which join what links to a bucket's head of the turn; texts that are in one component make no more pairs. Once
    the pairs between components are few beside the texts, a turn joins nothing, or the turns are over, all of them that
    can be similar are verified, so no link that joins two components is left out.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first")
    same = [F.first("n").alias("n"), F.first("usual").alias("usual"), F.min("fp").alias("fp"), F.first("prefix").alias("prefix")]
    nodes = materialize(marked.groupBy("node").agg(first, *same), "shingle-nodes")
    shared.unpersist()
    links = fingerprint_links(docs, nodes)
    parts = materialize(connected_components(links).select("node", F.col("component").alias("part")), "fingerprint-parts")
    few = parts.count() <= FEW_NODES
    whole = nodes.join(F.broadcast(parts) if few else parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    held = prefixes(whole, True).groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("rows"))
    held = materialize(held.where("low <> high").select("key", "rows"), "shared-keys")
    discard(links)
    # unpacked twice, not kept: most shingles of a prefix are in one text only
    spread = materialize(prefixes(nodes, False).join(held, "key"), "shared-prefixes")
    discard(held)
    whole = materialize(whole.drop("prefix", "fp"), "node-parts")
    discard(nodes, parts)
    nodes = whole
    placed = materialize(spread.join(nodes.select("node", "n", "usual", "part"), "node"), "shared-shingles")
    discard(spread)
    one, two = (nodes.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")

    def joined_by(asked, found):
        """The links between parts with those that ``asked`` adds, what they join (part, component), whether there were any."""
        links = confirmed(docs, nodes, asked)
        more = links.join(one, "a").join(two, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        found = materialize(more if found is None else found.unionByName(more), "part-links")
        joined = materialize(connected_components(found).select(F.col("node").alias("part"), "component"), "joined-parts")
        none = links.isEmpty()
        discard(asked, links)
        return found, joined, none

    def now_in(rows, joined):
        """``rows`` with the part that their part is joined to."""
        return rows.join(joined, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")

    found, joined, _ = joined_by(materialize(few_pairs(placed), "asked-pairs"), None)
    full = materialize(placed.where(F.col("rows") > FULL).drop("rows"), "full-shingles")
    discard(placed)
    placed, last = materialize(now_in(full, joined), "full-parts"), False
    for turn in range(TURNS + 1):
        mixed = materialize(crossing(placed), "mixed")
        rows, pairs = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if not pairs:
            break
        last = last or turn == TURNS or pairs <= rows
        asked = materialize(all_pairs(placed, mixed) if last else star_pairs(placed, mixed, turn), "asked-pairs")
        found, joined, none = joined_by(asked, found)
        if last:
            break
        last, before = none, placed
        # what only texts of one component share makes no more pairs
        placed = materialize(now_in(full.join(mixed.select("key"), "key", "left_semi"), joined), "full-parts")
        discard(before, mixed)
    return now_in(nodes.select("node", "first", "part"), joined).withColumnRenamed("part", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: its smallest doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs))
    heads = components(docs, sketches(docs, shared), shared).groupBy("component").agg(F.min("first").alias("head"))
    kept = heads.select(row_key(F.col("head.doc_id"), F.col("head.text_key")).alias("key"))
    return keep_rows(docs, text_key(), kept)
