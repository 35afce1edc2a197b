"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Equal vectors collapse first. A coarse k-means gives inverted lists, and what is left of a vector
beside its list's centre is coded in subspaces by small codebooks; both are fitted on a bounded sample,
all vectors are indexed. A vector probes the lists of its nearest centres, those whose centres score
nearly as well as its own, and, if it lies close to its centre, every list that can hold a link of it.
There, estimates come from lookup tables over the codes; each vector's coding error bounds how far its
estimate can be off, and what can reach the threshold is verified by the exact cosine in double precision.
Lists are dealt in blocks by their counted vectors and queries, so no list, however full, is one task, and
no candidate is dropped by number. A group of blocks counts links and hands on a tree of each of its
components instead of all pairs. A vector carries the lists that it probes, so a pair found from both
sides counts once.

Defined results: null, empty and zero vectors and those with null or non-finite components link with
nothing and are their own component; vectors of different lengths never link; equal vectors are
linked to each other; of repeated rows each counts; a null vec_id counts as a link but is no
component's id unless alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .components import connected_components

ship(__name__)
THRESHOLD = 0.9
#: Vectors that centres and codebooks are fitted on (the smallest hashes), at most.
SAMPLE = 32_768
#: Lists, at most; their centres are held by every task (4 MB in 64 dimensions).
LEAST_LISTS, MOST_LISTS = 16, 8192
#: So many lists or more are clustered in two levels.
TWO_LEVELS = 512
#: Vectors a list should hold; the number of lists follows the number of vectors.
PER_LIST = 100
#: Lists that every vector probes, at least.
PROBES = 8
#: A list is probed, too, if its centre's cosine falls short of the nearest one's by at most so much.
SLACK = 0.1
#: A vector within this angle (radians) of its nearest centre probes all lists that can hold a link.
TIGHT = 0.5
SUBSPACES = 16
CODES = 64
#: Vectors of a list, and queries to it, that one group holds, about.
BLOCK = 1024
#: Rows of an Arrow batch that dealing gives out, at most.
DEALT = 16_384


def kmeans(x, k: int, rounds: int, seed: int):
    """Centres of k clusters by squared distance, from a seeded start."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        for d in range(c.shape[1]):
            sums = np.bincount(near, x[:, d], len(c))
            n = np.bincount(near, minlength=len(c))
            c[:, d] = np.where(n > 0, sums / np.maximum(n, 1), c[:, d])
    return c


def fit(sample, n_lists: int):
    """(centres, codebooks): codebooks has CODES entries for each subspace of the residuals."""
    import numpy as np

    n_lists = min(n_lists, len(sample))
    if n_lists < TWO_LEVELS:
        centres = kmeans(sample, n_lists, 8, 1)
    else:  # clusters of clusters, as many in each as its share of the sample
        tops = kmeans(sample, int(n_lists**0.5), 8, 1)
        near = ((tops * tops).sum(1)[None] - 2 * sample @ tops.T).argmin(1)
        parts = [sample[near == k] for k in range(len(tops)) if (near == k).any()]
        centres = np.concatenate([kmeans(x, max(1, round(n_lists * len(x) / len(sample))), 6, 1000 + k) for k, x in enumerate(parts)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    own = np.concatenate([(sample[k : k + 1024] @ centres.T).argmax(1) for k in range(0, len(sample), 1024)])
    residual = sample - centres[own]
    width = sample.shape[1] // SUBSPACES
    books = [kmeans(residual[:, s * width : (s + 1) * width], min(CODES, len(sample)), 8, 2 + s) for s in range(SUBSPACES)]
    return centres, np.stack(books)


def probed(likeness, threshold: float, probes: int):
    """Which lists vectors probe, from their cosines with the centres: an array of (vectors, lists) flags.

    A link y of q at angle b = acos(threshold) is at most b + angle(q, own) from q's own centre, hence no
    farther from its own, nearest one, which is so at most 2 b + angle(q, own) from q: exact, and
    narrow where q lies close to its centre. Elsewhere the nearest centres and the slack decide.
    """
    import numpy as np

    wanted = min(probes, likeness.shape[1])
    out = likeness >= np.partition(likeness, -wanted, axis=1)[:, -wanted][:, None]
    best = likeness.max(axis=1, keepdims=True)
    out |= likeness >= best - SLACK
    angle = np.arccos(np.clip(best, -1, 1))
    reach = np.cos(np.minimum(2 * np.arccos(threshold) + angle, np.pi)) - 1e-9
    return out | ((angle <= TIGHT) & (likeness >= reach))


def encode(x, lists, centres, books):
    """The residual codes of vectors in their lists, an array of (vectors, SUBSPACES) bytes, and the norms
    of what the codes leave over."""
    import numpy as np

    residual, width = x - centres[lists], books.shape[2]
    out, left = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x))
    for s, book in enumerate(books):
        part = residual[:, s * width : (s + 1) * width]
        out[:, s] = (-2 * part @ book.T + (book * book).sum(1)[None]).argmin(1)
        left += ((part - book[out[:, s]]) ** 2).sum(1)
    return out, np.sqrt(left)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node, embedding, size, copies, first_id: one row for each different usable vector.

    ``node`` is any number of its own; the caller writes the table, so that it stays the same.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(F.col("embedding").isNotNull() & good)
    groups = usable.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    return groups.select(F.monotonically_increasing_id().alias("node"), "embedding", F.size("embedding").alias("size"), "copies", "first_id")


def unit_rows(column, width: int):
    """Vectors of one Arrow list column as rows of length one, in double precision, padded by zeros."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    out = np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], length)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # no overflow in the norm
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def roots(a, b):
    """The nodes of some links and, for each, the smallest one that the links lead to."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def near_links(vectors: DataFrame, n: int, width: int, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """node, other, links: how many vectors (copies counted) a node has at a cosine of at least ``threshold``, in
    parts (other is null), and a tree over each component of a group (links is 0). All verified exactly."""
    import numpy as np

    spark = vectors.sparkSession
    share = min(1.0, SAMPLE / max(n, 1))
    picked = vectors.where(F.xxhash64("embedding") <= min(int(-(2**63) + share * 2**64), 2**63 - 1)).select("embedding").toArrow()
    width += -width % SUBSPACES
    sample = unit_rows(picked.column(0).combine_chunks(), width) if picked.num_rows else np.eye(1, width)
    n_lists = int(min(MOST_LISTS, max(LEAST_LISTS, n // PER_LIST)))
    shared = spark.sparkContext.broadcast(fit(sample, n_lists))

    def count(batches):
        """How many vectors of a batch lie in and probe each list."""
        centres, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            likeness = unit_rows(batch.column(0), width) @ centres.T
            mine, asked = np.bincount(likeness.argmax(1), minlength=len(centres)), probed(likeness, threshold, probes).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(mine.astype(np.int64)), pa.array(asked.astype(np.int64))], ["list", "mine", "asked"]
            )

    sums = vectors.select("embedding").mapInArrow(count, "list int, mine long, asked long").groupBy("list")
    blocks = {r["list"]: (-(-r.mine // BLOCK), -(-r.asked // BLOCK)) for r in sums.agg(F.sum("mine").alias("mine"), F.sum("asked").alias("asked")).collect()}

    def spread(at, times):
        """Each of ``at`` so many times, and the number of each repetition."""
        return np.repeat(at, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    def deal(batches):
        """Index rows (kind 0, own list and block, all query blocks) and query rows (kind 1, probed lists, all index blocks)."""
        centres, books = shared.value
        parts = np.array([blocks.get(k, (1, 1)) for k in range(len(centres))])
        n_index, n_query = np.maximum(parts, 1).T
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                node = batch.column(0).to_numpy()
                x = unit_rows(batch.column(1), width)
                likeness = x @ centres.T
                at_query, near = np.nonzero(probed(likeness, threshold, probes))
                own = likeness.argmax(1)
                times = np.bincount(at_query, minlength=len(node))
                asks_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.array(near.astype(np.int32)))
                codes, left = encode(x, own, centres, books)
                # a block pair (index block i, query block q) of a list is one group
                held, q = spread(np.arange(len(node)), n_query[own])
                asks, i = spread(np.arange(len(near)), n_index[near])
                asked, lists = at_query[asks], near[asks]
                for kind, at, lists, i, q in (
                    (0, held, own[held], node[held] % n_index[own[held]], q),
                    (1, asked, lists, i, node[asked] % n_query[lists]),
                ):
                    for k in range(0, len(at), DEALT):
                        part = slice(k, k + DEALT)
                        rows = pa.array(at[part])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows), kind, np.int8)), pa.array(lists[part].astype(np.int32)), pa.array(i[part].astype(np.int32)), pa.array(q[part].astype(np.int32)),
                                batch.column(2).take(rows), pa.array(node[at[part]]), batch.column(1).take(rows), batch.column(3).take(rows),
                                pa.array([c.tobytes() for c in codes[at[part]]] if kind == 0 else [b""] * len(rows), pa.binary()),
                                pa.array(left[at[part]]), pa.array(own[at[part]].astype(np.int32)),
                                asks_of.take(rows) if kind == 0 else pa.array([[]] * len(rows), pa.list_(pa.int32())),
                            ],
                            ["kind", "list", "i", "q", "size", "node", "embedding", "copies", "codes", "error", "own", "asks"],
                        )

    def search(key, group):
        """Links of one block pair: table lookups over codes, then the exact cosine."""
        centres, books = shared.value
        kind = group.column("kind").to_numpy()
        mine, query = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        found_r, found_c = [], []
        if not len(mine) or not len(query):
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        index, asked = group.take(pa.array(mine)), group.take(pa.array(query))
        y = unit_rows(index.column("embedding").combine_chunks(), width)
        code = np.frombuffer(b"".join(index.column("codes").to_pylist()), np.uint8).reshape(len(mine), -1)
        error = index.column("error").to_numpy()
        b, a = index.column("node").to_numpy(), asked.column("node").to_numpy()
        x = unit_rows(asked.column("embedding").combine_chunks(), width)
        part = books.shape[2]
        for k in range(0, len(x), 512):
            q = x[k : k + 512]
            estimate = np.tile((q @ centres[key[0].as_py()])[:, None], (1, len(y)))
            for s, book in enumerate(books):
                estimate += (q[:, s * part : (s + 1) * part] @ book.T)[:, code[:, s]]
            # |q| = 1, so a cosine is at most the estimate and the norm of what the code leaves over
            r, c = np.nonzero(estimate + error[None] >= threshold - 1e-9)
            other = a[k + r] != b[c]
            r, c = r[other], c[other]
            cosine = (q @ y.T)[r, c]
            found_r.append(k + r[cosine >= threshold])
            found_c.append(c[cosine >= threshold])
        r, c = np.concatenate(found_r), np.concatenate(found_c)
        # the index vector meets this pair as a query, too, where it probes the other's list
        asks = index.column("asks").combine_chunks()
        pairs = np.repeat(np.arange(len(mine)), asks.value_lengths().to_numpy()) * len(centres) + asks.flatten().to_numpy()
        alone = ~np.isin(c * len(centres) + asked.column("own").to_numpy()[r], pairs)
        links_a = np.bincount(r, index.column("copies").to_numpy()[c], len(a)).astype(np.int64)
        links_b = np.bincount(c[alone], asked.column("copies").to_numpy()[r[alone]], len(b)).astype(np.int64)
        nodes, root = roots(a[r], b[c])
        tree = nodes != root
        some_a, some_b = links_a > 0, links_b > 0
        counts = np.concatenate([links_a[some_a], links_b[some_b]])
        node = np.concatenate([a[some_a], b[some_b], nodes[tree]])
        other = np.concatenate([np.zeros(len(counts), np.int64), root[tree]])
        return pa.table({
            "node": node,
            "other": pa.array(other, pa.int64(), mask=np.arange(len(node)) < len(counts)),
            "links": np.concatenate([counts, np.zeros(len(node) - len(counts), np.int64)]),
        })

    vector = vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.select("node", "embedding", "size", "copies").mapInArrow(
        deal, f"kind byte, list int, i int, q int, size int, node long, embedding {vector}, copies long, codes binary, error double, own int, asks array<int>"
    )
    return dealt.groupBy("list", "i", "q", "size").applyInArrow(search, "node long, other long, links long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding)."""
    kind = "array<double>" if "double" in rows.schema["embedding"].dataType.simpleString() else "array<float>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    vectors = materialize(distinct_vectors(rows), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    found = materialize(near_links(vectors, n, width, threshold), "vector-links")
    degree = found.where("other is null").groupBy("node").agg(F.sum("links").alias("others"))
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = vectors.join(parts, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "vector-parts")
    # the heads are a table of their own, so that the join back can split a component that holds much
    heads = materialize(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "component-heads")
    placed = placed.join(heads, "component").select("embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(materialize(placed, "placed-vectors"), "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs: for small tables only. At those sizes the probes miss none of the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
walk(node, seen) AS (SELECT a, b FROM links UNION SELECT walk.node, links.b FROM walk JOIN links ON links.a = walk.seen),
part AS (SELECT node, least(node, min(seen)) AS c FROM walk GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON a = vec_id LEFT JOIN part ON node = vec_id"""
