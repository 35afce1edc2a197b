"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (4 and 5 characters, which carry
inflected forms). All that is learned comes from about ``MAX_SAMPLE`` labelled rows at most, the documented
bound: Spark sums the features' class counts over them, the features that tell the classes apart most are
kept, and a logistic model is fitted; beside the usual loss it pays for every sentence whose score changes
when its identity terms are swapped for others of their group, so that the mention of a group alone does
not raise a score. Whole texts are then scored in Arrow batches. :func:`drop_toxic` learns from all labelled
rows, held-out ones too: what it catches among labelled rows says nothing of others.

Defined results: null and empty texts score the prior; null doc_id is hashed as the text ''; rows
without a label or with a null label teach nothing; repeated rows teach and score alike; a table
without both labels gives every text the prior; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship

ship(__name__)
#: About the most labelled rows the model is fitted on, those with the smallest hashes: the documented bound.
MAX_SAMPLE = 40_000
N_FEATURES = 2_000
#: Counts that a task holds before it sends them on, and what one text adds; Spark sums them before the shuffle.
HELD = 100_000
#: Chance gives one in a million features a G squared above this.
LEAST_G2 = 24.0
THRESHOLD = 0.7
PENALTY = 1.0
RIDGE = 1e-5
STEPS = 400
#: Terms that name groups; within a line any may stand for any other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "locals"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str | None) -> set[str]:
    """Words (w:) and word beginnings (4:, 5:) of a text, each once."""
    words = set(TOKEN.findall((text or "").lower()))
    found = {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}
    return words | found


def labelled(docs: DataFrame, labels: DataFrame, held_out: bool = True, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """text, toxic (0 or 1) of the labelled rows that are learned from.

    Of more than ``max_sample`` labels a hashed share of about that many is taken, so the label side
    of the join is bounded and is broadcast: texts are filtered where they are read, never shuffled.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out:
        marks = marks.where(~is_held_out())
    marks = materialize(marks, "marks")
    share = 0.98 * max_sample / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.xxhash64("doc_id") < int(-(2**63) + share * 2**64))
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")
    # ids that repeat bring more rows than labels; a hashed share of the rows keeps to the bound
    rows = materialize(rows.withColumn("turn", F.xxhash64("text", F.monotonically_increasing_id())), "labelled-rows")
    share = max_sample / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.col("turn") < int(-(2**63) + share * 2**64))
    return rows.drop("turn")


def is_held_out():
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n0, n1: documents of each class that have it. Tasks sum before the shuffle."""

    def run(batches):
        from collections import Counter

        seen = (Counter(), Counter())

        def out():
            for toxic, c in enumerate(seen):  # a table of both would hold all keys a second time
                n = [pa.array(c.values(), pa.int64()), pa.array([0] * len(c), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), *(n[::-1] if toxic else n)], ["feature", "n0", "n1"])
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(features(text))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield from out()
        yield from out()

    partial = rows.select("text", "toxic").mapInArrow(run, "feature string, n0 long, n1 long")
    return partial.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def choose_features(counts: DataFrame, n0: int, n1: int, n_features: int) -> list[str]:
    """The features that tell the classes apart most, by likelihood ratio (G squared), and every
    identity term seen. Below LEAST_G2 an association may be chance, so few rows teach few features.
    """
    share1, n = n1 / (n0 + n1), F.col("n0") + F.col("n1")

    def part(seen, rows, share):
        gone = rows - seen
        on = F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
        return on + F.when(gone > 0, gone * F.log(gone / ((n0 + n1 - n) * share))).otherwise(0.0)

    g2 = 2 * (part(F.col("n1"), n1, share1) + part(F.col("n0"), n0, 1 - share1))
    best = counts.select("feature", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(n_features)
    terms = [t for g in IDENTITY_GROUPS for t in g]
    return sorted({r[0] for r in best.collect()} | {r[0] for r in counts.where(F.col("feature").isin(terms)).select("feature").collect()})


def swapped(sentence: str) -> list[str]:
    """The sentence with its identity terms swapped for the next one of their group."""
    out, low = [], sentence.lower()
    for group in IDENTITY_GROUPS:
        if any(re.search(rf"\b{t}\b", low) for t in group):
            turn = {t: group[(k + 1) % len(group)] for k, t in enumerate(group)}
            out.append(re.sub(r"\w+", lambda m: turn.get(m[0], m[0]), low))
    return out


def encode(rows: DataFrame, index: dict[str, int]) -> DataFrame:
    """toxic, on (features present), swaps (of each counterfactual pair: features gone, features come)."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(index)

    def run(batches):
        own = shared.value
        terms = {t for g in IDENTITY_GROUPS for t in g}
        for batch in batches:
            on, swaps = [], []
            for text in batch.column(0).to_pylist():
                found = features(text)
                on.append(sorted(own[f] for f in found if f in own))
                pairs = []
                if found & terms:
                    for s in SENTENCE.findall(text):
                        for t in swapped(s):
                            x, y = features(s), features(t)
                            pairs.append({"gone": sorted(own[f] for f in x - y if f in own), "come": sorted(own[f] for f in y - x if f in own)})
                swaps.append([p for p in pairs if p["gone"] or p["come"]])
            kind = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(on, pa.list_(pa.int32())), pa.array(swaps, kind)], ["toxic", "on", "swaps"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, on array<int>, swaps array<struct<gone:array<int>,come:array<int>>>")


def fit_weights(sample: list, n_features: int, penalty: float = PENALTY):
    """Adagrad on the logistic loss, the swap penalty and a ridge; the last weight is the bias.

    Both classes weigh the same, however rare one is.
    """
    import numpy as np

    y = np.array([r[0] for r in sample], float)
    row = np.repeat(np.arange(len(sample)), [len(r[1]) for r in sample])
    col = np.concatenate([np.asarray(r[1], np.int64) for r in sample]) if len(row) else np.zeros(0, np.int64)
    pairs = [p for r in sample for p in r[2]]
    gone = np.repeat(np.arange(len(pairs)), [len(p["gone"]) for p in pairs]).astype(np.int64)
    come = np.repeat(np.arange(len(pairs)), [len(p["come"]) for p in pairs]).astype(np.int64)
    gone_f = np.array([f for p in pairs for f in p["gone"]], np.int64)
    come_f = np.array([f for p in pairs for f in p["come"]], np.int64)
    share = y.mean()
    each = np.where(y == 1, (1 - share) / share, 1.0)
    each /= each.sum()
    w, past = np.zeros(n_features + 1), np.full(n_features + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(row, w[col], len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * each
        g = np.append(np.bincount(col, e[row], n_features), e.sum())
        if pairs:
            d = np.bincount(come, w[come_f], len(pairs)) - np.bincount(gone, w[gone_f], len(pairs))
            d *= 2 * penalty / len(pairs)
            g[:-1] += np.bincount(come_f, d[come], n_features) - np.bincount(gone_f, d[gone], n_features)
        g[:-1] += RIDGE * w[:-1]
        past += g * g
        w -= 0.3 * g / np.sqrt(past)
    return w


def train(docs: DataFrame, labels: DataFrame, held_out: bool = True, max_sample: int = MAX_SAMPLE, n_features: int = N_FEATURES, penalty: float = PENALTY) -> tuple[dict[str, float], float]:
    """feature -> weight, and the bias."""
    import math

    bounded_batches(docs.sparkSession)
    rows = labelled(docs, labels, held_out, max_sample)
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}, math.log((n1 + 1) / (n0 + 1))
    names = choose_features(materialize(feature_counts(rows), "features"), n0, n1, n_features)
    sample = encode(rows, {f: k for k, f in enumerate(names)}).collect()
    w = fit_weights(sample, len(names), penalty)
    return {f: float(w[k]) for k, f in enumerate(names) if abs(w[k]) > 1e-9}, float(w[-1])


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """All columns of ``docs``, packed in the struct ``row``, and ``score``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    held = docs.select(F.struct("*").alias("row"), F.col("text"))

    def run(batches):
        import math

        own = shared.value
        words = {f for f in own if not f.endswith("~")}
        heads = {f[:-1] for f in own if f.endswith("~")}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                seen = set(TOKEN.findall((text or "").lower()))
                z = bias + sum(own[f] for f in sorted(seen & words))
                begun = ({w[:4] for w in seen if len(w) > 4} | {w[:5] for w in seen if len(w) > 5}) & heads
                z += sum(own[f + "~"] for f in sorted(begun))
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([held.schema["row"]]).add("score", DoubleType())
    return held.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    weights, bias = train(docs, labels, held_out=False)
    return score(docs, weights, bias).where(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), weights, bias).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
