"""A hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history). A word's class is a hash of its last
letters, so a word never seen has a class as well.

*Class factor.* A softmax over the features of the two classes before: one back, two back (a skip) and
both. Where the two words before are a known context, hashed features of that word pair and the class
are added to its scores.

*Word factor.* A softmax over the words of the class. Its base is the add-``ALPHA`` share of a word in its
class, where each class keeps one unseen word. On it stand hashed features of history and word: of the
two words before (a trigram), of the word before (a bigram) and of the word two back (a skip). Of these
contexts the first that is known for the class fires, so features of a context meet those of no other,
and the normaliser of a context is 1 + the sum of base * (exp(weight) - 1) over its featured words:
exact and sparse. Both factors sum to one, so the model is a distribution.

Training counts words and class triples over all training texts, then all n-grams and skips of words:
tasks send sorted blocks of hashed keys, and a group of a range of contexts adds them up. What is seen
``LEAST_SEEN`` times or more is a feature. Weights are trained by gradient steps: those of classes on
Spark jobs whose partial gradients are summed by feature, those of words within the group that has
their context, as no other group touches them. The trained features are kept in a hashed table of at
most ``MAX_SLOTS`` places, sized by the training tokens; where two meet in a place, the one that
explains more stays, before weights and normalisers are computed. Scoring looks batches of tokens up
in the table, with numpy. Counts of frequent words come from a bounded table; those of all other words
by a join, so nothing that grows with the vocabulary is broadcast.

Defined results: null and empty texts are one end token; null doc_id hashes as the text ''; repeated
rows count and score each by itself; with no training text every token is unknown; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship

ship(__name__)
ALPHA = 0.1
FOLDS = 10
END = b"\n"  # no word holds white space
#: Words whose counts every task holds, and which have features as the next word: the most frequent, at most so many.
MAX_FREQUENT = 50_000
CLASSES = 64
END_CLASS = 0
STEPS = 10
RATE = 0.7
#: Places of the table of word features, and of that of contexts, at most: 24 MB each.
MAX_SLOTS = 1 << 21
#: n-grams and skips seen less often are no features.
LEAST_SEEN = 2
#: Variance of the prior on the weights of words.
PRIOR = 8.0
WORD_STEPS = 8
#: Keys that one group of contexts adds up, about.
GROUP_KEYS = 500_000
#: Tokens that a task counts before it sends them.
FLUSH = 400_000
#: Distinct words that a task counts before it sends them.
FLUSH_WORDS = 150_000
#: A key is a context of CONTEXT_BITS bits and a word number of 16 bits. Frequent words come first; the other
#: words of class c are RARE + c, and a class as what follows a context is WHOLE + c.
CONTEXT_BITS = 36
RARE, WHOLE = 65_408, 65_472
#: Multipliers of hashes, fixed values.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def is_held_out():
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    """A hash of the word's last letters; the end token has a class of its own."""
    if word == END:
        return END_CLASS
    return 1 + zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % (CLASSES - 1)


class Codes(dict):
    """word -> number * CLASSES + class. Frequent words are given; others get 65536 + a hash, and a
    bounded number of them is remembered."""

    most = 60_000

    def __missing__(self, word: bytes) -> int:
        code = (65_536 + zlib.crc32(word)) * CLASSES + class_of(word)
        if len(self) < self.most:
            self[word] = code
        return code


def coded(docs: list[list[bytes]], codes: Codes):
    """For all tokens of some documents (their end tokens among them): the code, those of the two tokens
    before it, and the documents' lengths. Two end tokens stand before a document."""
    import numpy as np

    flat: list[bytes] = []
    for words in docs:
        flat += (END, END)
        flat += words
    all_codes = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    length = np.fromiter(map(len, docs), np.int64, len(docs))
    first = np.cumsum(length + 2) - length
    token = np.ones(len(flat), bool)
    token[first - 1] = token[first - 2] = False
    at = np.flatnonzero(token)
    return all_codes[at], all_codes[at - 1], all_codes[at - 2], length


def contexts(one, two):
    """The hashed contexts of tokens, from the codes one and two back: both words, the word before, the
    word two back. The lowest 12 bits of the first hold the two classes; bit 12 tells it from the others."""
    import numpy as np

    def mixed(x):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
        return x ^ (x >> np.uint64(32))

    a, b = one.astype(np.uint64) * np.uint64(MIX[0]), two.astype(np.uint64) * np.uint64(MIX[1])
    top = np.uint64(CONTEXT_BITS - 13)
    cut = np.uint64(64) - top
    pair = (one % CLASSES + two % CLASSES * CLASSES).astype(np.uint64)
    both = ((mixed(a + b + np.uint64(MIX[2])) >> cut) << np.uint64(13)) | np.uint64(1 << 12) | pair
    rest = np.uint64(0xFFF)
    h = mixed(a + np.uint64(1))
    near = ((h >> cut) << np.uint64(13)) | (h & rest)
    h = mixed(b + np.uint64(2))
    far = ((h >> cut) << np.uint64(13)) | (h & rest)
    return both, near, far


def spread(keys):
    """64-bit hashes of keys."""
    import numpy as np

    x = keys * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(33))


def places(keys, context, groups: int, slots: int):
    """Where keys stand in a table of ``slots`` places, of which each group of contexts owns an equal run."""
    import numpy as np

    own = np.uint64(slots // groups)
    return group_of(context, groups).astype(np.uint64) * own + spread(keys) % own


def group_of(context, groups: int):
    import numpy as np

    return (context >> np.uint64(CONTEXT_BITS - groups.bit_length() + 1)).astype(np.int32)


def counted(docs: DataFrame) -> DataFrame:
    """kind, key (binary), n over the training texts: words (kind 0, the end among them) and triples of
    classes (kind 1, the code (two back * CLASSES + one back) * CLASSES + class). Tasks count first."""

    def run(batches):
        from collections import Counter

        import numpy as np

        seen: Counter = Counter()
        codes, cells = Codes({END: END_CLASS}), np.zeros(CLASSES**3, np.int64)

        def out(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            docs = [[*words_of(t), END] for t in batch.column(0).to_pylist()]
            if not docs:
                continue
            for words in docs:
                seen.update(words)
            code, one, two, _ = coded(docs, codes)
            cells += np.bincount(((two % CLASSES) * CLASSES + one % CLASSES) * CLASSES + code % CLASSES, minlength=CLASSES**3)
            if len(seen) > FLUSH_WORDS:
                yield out(0, list(seen), list(seen.values()))
                seen.clear()
        yield out(0, list(seen), list(seen.values()))
        at = np.flatnonzero(cells)
        yield out(1, [int(k).to_bytes(4, "big") for k in at], cells[at])

    found = docs.where(~is_held_out()).select("text").mapInArrow(run, "kind byte, key binary, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = MAX_FREQUENT) -> dict[bytes, int]:
    """The ``most`` most frequent words (the end aside) and their counts; of equal counts the lesser words.

    A histogram of the counts' logarithms, a few thousand rows at most, says which bands are whole;
    only the band that the limit cuts is ordered.
    """
    words = counts.where(F.col("word") != F.lit(END)).withColumn("band", F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int"))
    left, whole, cut = most, None, None
    for r in sorted(words.groupBy("band").count().collect(), reverse=True):
        if r["count"] > left:
            cut = r["band"]
            break
        left, whole = left - r["count"], r["band"]
    found = []
    if whole is not None:
        found += words.where(F.col("band") >= whole).select("word", "n").collect()
    if cut is not None and left:
        found += words.where(F.col("band") == cut).orderBy(F.desc("n"), "word").select("word", "n").limit(left).collect()
    return {bytes(r[0]): r[1] for r in sorted(found, key=lambda r: (-r[1], r[0]))}


FEATURES = ("1", "2", "12")


def feature_rows(history):
    """The rows of the class weights for histories two back * CLASSES + one back: a row for each of FEATURES."""
    import numpy as np

    h = np.asarray(history, np.int64)
    return np.stack([h % CLASSES, CLASSES + h // CLASSES, 2 * CLASSES + h])


def log_classes(weights, bias):
    """log p(class | the two classes before): an array of (histories, classes)."""
    import numpy as np

    z = bias + weights[feature_rows(np.arange(CLASSES**2))].sum(axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_sums(cells: DataFrame, model=None) -> DataFrame:
    """row (of the class weights), mass (CLASSES 64-bit sums): the tokens seen with each feature and class,
    or with ``model`` (weights and bias) those it expects. Tasks add up over their histories first."""
    shared = cells.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        n = np.zeros((CLASSES**2, CLASSES))
        for batch in batches:
            np.add.at(n, (batch.column(0).to_numpy(), batch.column(1).to_numpy()), batch.column(2).to_numpy())
        own = np.flatnonzero(n.any(axis=1))
        mass = n[own]
        if shared.value is not None:
            mass = np.exp(log_classes(*shared.value)[own]) * mass.sum(axis=1, keepdims=True)
        sums = np.zeros((2 * CLASSES + CLASSES**2, CLASSES))
        for rows in feature_rows(own):
            np.add.at(sums, rows, mass)
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["row", "mass"])

    parts = cells.mapInArrow(run, "row int, mass array<double>")
    return parts.groupBy("row").agg(F.array(*[F.sum(F.col("mass")[k]) for k in range(CLASSES)]).alias("mass"))


def fit_classes(cells: DataFrame, steps: int = STEPS):
    """weights (a row of CLASSES for each feature) and bias, by distributed gradient steps.

    ``cells`` has history, class, n: CLASSES ** 3 rows at most. A step moves each weight along its
    gradient, seen - expected, scaled by its curvature, about the mean of the two, and by the number
    of features that fire together.
    """
    import numpy as np

    def gathered(model=None):
        out = np.zeros((2 * CLASSES + CLASSES**2, CLASSES))
        for row, mass in class_sums(cells, model).collect():
            out[row] = mass
        return out

    n = np.full(CLASSES, 0.5)
    for r in cells.groupBy("class").agg(F.sum("n")).collect():
        n[r[0]] += r[1]
    bias, seen = np.log(n / n.sum()), gathered()
    weights = np.zeros_like(seen)
    for _ in range(steps):
        expected = gathered((weights, bias))
        weights += RATE * (seen - expected) / (0.5 * (seen + expected) + 2.0)
    return weights, bias


def packed(keys, counts) -> tuple[bytes, bytes]:
    """Sorted keys as the byte planes of their differences, and (place, count) of those not seen once."""
    import numpy as np

    step = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()
    more = np.flatnonzero(counts > 1)
    return planes, np.stack([more, counts[more]]).astype(np.int64).tobytes()


def unpacked(planes: bytes, more: bytes):
    import numpy as np

    step = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    keys, counts = np.cumsum(step, dtype=np.uint64), np.ones(len(step), np.int64)
    at, n = np.frombuffer(more, np.int64).reshape(2, -1)
    counts[at] = n
    return keys, counts


def summed(held: list):
    """The distinct keys of some arrays, sorted, and how often each is there. Empties the list, so that an array goes
    before the next is made."""
    import numpy as np

    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    start, _ = starts_of(keys)
    return keys[start], np.diff(start, append=len(keys))


def word_grams(docs: DataFrame, known, groups: int) -> DataFrame:
    """context_group, keys, more: the n-grams and skips of the training texts, as blocks of sorted keys."""

    def run(batches):
        import numpy as np

        codes = Codes(known.value["codes"])
        codes.most = len(codes) + Codes.most
        held, size = [], 0

        def out():
            keys, n = summed(held)
            group = group_of(keys >> np.uint64(16), groups)
            numbers, start = np.unique(group, return_index=True)
            blocks = [packed(k, c) for k, c in zip(np.split(keys, start[1:]), np.split(n, start[1:]))]
            for low in range(0, len(numbers), 1024):
                part = slice(low, low + 1024)
                planes, more = zip(*blocks[part])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[part]), pa.array(planes, pa.binary()), pa.array(more, pa.binary())], ["context_group", "keys", "more"])

        for batch in batches:
            docs = [[*words_of(t), END] for t in batch.column(0).to_pylist()]
            if not docs:
                continue
            code, one, two, _ = coded(docs, codes)
            number = code // CLASSES
            number = np.where(number < 65_536, number, RARE + code % CLASSES).astype(np.uint64)
            held += [(c << np.uint64(16)) | number for c in contexts(one, two)]
            size += len(code)
            if size >= FLUSH:
                yield from out()
                size = 0
        if held:
            yield from out()

    return docs.where(~is_held_out()).select("text").mapInArrow(run, "context_group int, keys binary, more binary")


def starts_of(x):
    """Where runs of equal values of a sorted array begin, and the run of every place."""
    import numpy as np

    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new, dtype=np.int32 if len(x) < 1 << 31 else np.int64) - 1


def fit_words(base, n, run, total):
    """Weights of features in runs (one for each context and class), and the logarithm of each run's normaliser.

    Gradient steps on the likelihood of a run's ``total`` tokens with a Gaussian prior, scaled by curvature.
    """
    import numpy as np

    all_n = total[run]
    w = np.log(np.maximum(n / (all_n + 1.0), 1e-12) / base)
    add = lambda x: np.bincount(run, x, len(total))
    for _ in range(WORD_STEPS):
        mass = base * np.exp(w)
        p = mass / np.maximum(1 + add(mass - base), 1e-12)[run]
        gradient = n - all_n * p - w / PRIOR
        w = np.clip(w + np.clip(gradient / (all_n * p * (1 - p) + 0.1 * n + 1 / PRIOR), -1, 1), -12, 12)
    return w, np.log(np.maximum(1 + add(base * np.expm1(w)), 1e-12))


def kept_in_place(place, gain, n_places: int):
    """Which entries hold their places: in each the one of the largest gain."""
    import numpy as np

    order = np.argsort(gain, kind="stable")
    holder = np.full(n_places, -1, np.int64)
    holder[place[order]] = order
    out = np.zeros(len(place), bool)
    out[holder[holder >= 0]] = True
    return out


def word_features(keys, n, log_base, log_class, number: int, groups: int, slots: int):
    """The table entries of one group of contexts from its summed keys: (context keys, log normalisers,
    feature keys, weights).

    A context key is context << 7 | class, with class CLASSES for the features of whole classes.
    """
    import numpy as np

    sixteen = np.uint64(16)
    start, run = starts_of(keys >> sixteen)
    again = (np.add.reduceat(n, start) >= LEAST_SEEN)[run]
    keys, n = keys[again], n[again]
    number_of = (keys & np.uint64(0xFFFF)).astype(np.int64)
    cls, context = log_base["class"][number_of], keys >> sixteen
    by = np.argsort((context << np.uint64(6)) | cls.astype(np.uint64), kind="stable")
    context, n, number_of, cls = context[by], n[by], number_of[by], cls[by]
    part = (context << np.uint64(7)) | cls.astype(np.uint64)
    start, run = starts_of(part)
    total = np.bincount(run, n, len(start)).astype(np.int64)
    # words after a context, within their class
    word = (n >= LEAST_SEEN) & (number_of < RARE)
    entries = [(part[word], context[word], number_of[word], n[word], total[run[word]], log_base["word"][number_of[word]])]
    # classes after two words
    whole = ((context[start] >> np.uint64(12)) & np.uint64(1)).astype(bool)
    c_context, c_class, c_n = context[start][whole], cls[start][whole], total[whole]
    c_start, c_run = starts_of(c_context)
    c_total = np.bincount(c_run, c_n, len(c_start))[c_run]
    seen = c_n >= LEAST_SEEN
    history = (c_context & np.uint64(0xFFF)).astype(np.int64)
    entries.append(((c_context << np.uint64(7) | np.uint64(CLASSES))[seen], c_context[seen], WHOLE + c_class[seen], c_n[seen], c_total[seen], log_class[history[seen], c_class[seen]]))
    part, context, number_of, n, total, base = (np.concatenate(x) for x in zip(*entries))
    gain = n * (np.log(n / total) - base)
    useful = gain > 0.5
    part, context, number_of, n, total, base, gain = (x[useful] for x in (part, context, number_of, n, total, base, gain))
    own, low = slots // groups, np.uint64(number * (slots // groups))
    # contexts hold their places first, then the features of those that did
    by = np.argsort(part, kind="stable")
    part, context, number_of, n, total, base, gain = (x[by] for x in (part, context, number_of, n, total, base, gain))
    start, run = starts_of(part)
    holds = kept_in_place((places(part[start], context[start], groups, slots) - low).astype(np.int64), np.bincount(run, gain, len(start)), own)[run]
    part, context, number_of, n, total, base, gain = (x[holds] for x in (part, context, number_of, n, total, base, gain))
    key = (context << sixteen) | number_of.astype(np.uint64)
    holds = kept_in_place((places(key, context, groups, slots) - low).astype(np.int64), gain, own)
    part, key, n, total, base = (x[holds] for x in (part, key, n, total, base))
    start, run = starts_of(part)
    weights, norms = fit_words(np.exp(base), n, run, total[start])
    return part[start], norms, key, weights


def word_table(grams: DataFrame, log_base, log_class, groups: int, slots: int) -> DataFrame:
    """context_group and the entries of its places, as binary columns: one row for each group."""
    shared = grams.sparkSession.sparkContext.broadcast((log_base, log_class))

    def merge(key, group):
        import numpy as np

        held, again = [], []
        for planes, more in zip(group.column("keys"), group.column("more")):
            k, c = unpacked(planes.as_buffer(), more.as_buffer())
            often = np.flatnonzero(c > 1)
            held.append(k)
            again.append((k[often], c[often] - 1))
        keys, n = summed(held)
        for k, more in again:
            np.add.at(n, np.searchsorted(keys, k), more)
        del again
        parts = word_features(keys, n, *shared.value, key[0].as_py(), groups, slots)
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        columns = [pa.array([np.asarray(x).astype(k).tobytes()], pa.binary()) for x, k in zip(parts, kinds)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *columns], names=["context_group", "contexts", "norms", "features", "weights"])

    schema = "context_group int, contexts binary, norms binary, features binary, weights binary"
    return grams.groupBy("context_group").applyInArrow(merge, schema)


def hash_table(shards, groups: int, slots: int) -> tuple:
    """The rows of :func:`word_table` as arrays of ``slots`` places: context keys, norms, feature keys, weights."""
    import numpy as np

    free = np.uint64(2**64 - 1)
    out = (np.full(slots, free), np.zeros(slots, np.float32), np.full(slots, free), np.zeros(slots, np.float32))
    for r in shards:
        part, norms = np.frombuffer(r["contexts"], np.uint64), np.frombuffer(r["norms"], np.float32)
        key, weights = np.frombuffer(r["features"], np.uint64), np.frombuffer(r["weights"], np.float32)
        at = places(part, part >> np.uint64(7), groups, slots)
        out[0][at], out[1][at] = part, norms
        at = places(key, key >> np.uint64(16), groups, slots)
        out[2][at], out[3][at] = key, weights
    return out


def log_lifts(code, one, two, log_class, table, groups: int):
    """For tokens and the codes before them: log p(class | history) and what the features of words add to the
    logarithm of the word's share in its class."""
    import numpy as np

    context_keys, norms, feature_keys, weights = table
    slots, cls = len(norms), code % CLASSES
    number = code // CLASSES
    number = np.where(number < 65_536, number, RARE + cls).astype(np.uint64)
    both, near, far = contexts(one, two)
    out = log_class[two % CLASSES * CLASSES + one % CLASSES, cls].astype(float)

    def lift(at, context, part_class, follows):
        """Adds the lift of the tokens ``at`` whose context is known for the class; returns the others."""
        part = (context << np.uint64(7)) | part_class
        place = places(part, context, groups, slots)
        known = context_keys[place] == part
        yes = at[known]
        key = (context[known] << np.uint64(16)) | follows[known]
        mine = places(key, context[known], groups, slots)
        out[yes] += np.where(feature_keys[mine] == key, weights[mine], 0) - norms[place[known]]
        return at[~known]

    cls = cls.astype(np.uint64)
    left = np.arange(len(code))
    lift(left, both, np.uint64(CLASSES), np.uint64(WHOLE) + cls)
    for context in (both, near, far):
        left = lift(left, context[left], cls[left], number[left])
    return out


class Model:
    """What scoring needs of the training texts: bounded tables, whatever the corpus."""

    def __init__(self, docs: DataFrame, steps: int = STEPS):
        import numpy as np

        spark = docs.sparkSession
        sc = spark.sparkContext
        bounded_batches(spark)
        every = materialize(counted(docs), "word-counts")
        self.counts = every.where("kind = 0").select(F.col("key").alias("word"), "n")
        self.total, self.vocabulary = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        code = F.conv(F.hex("key"), 16, 10).cast("int")
        cells = every.where("kind = 1").select(F.floor(code / CLASSES).cast("int").alias("history"), (code % CLASSES).alias("class"), "n")
        # at most CLASSES ** 3 rows: few tasks, each with whole histories
        cells = materialize(cells.repartition(min(sc.defaultParallelism, 16), "history"), "class-cells")
        self.log_class = log_classes(*fit_classes(cells, steps)).astype(np.float32)
        ends = self.counts.where(F.col("word") == F.lit(END)).select("n").collect()
        words = {END: ends[0][0] if ends else 0} | frequent_words(self.counts)
        self.codes = {w: k * CLASSES + class_of(w) for k, w in enumerate(words)}
        # p(word | class): what the class has of tokens, ALPHA for each of its words and one unseen
        self.in_class = np.full(CLASSES, ALPHA)
        for r in class_sizes(self.counts).collect():
            self.in_class[r[0]] += r[1] + ALPHA * r[2]
        self.log_count = np.log10(np.array(list(words.values())) + ALPHA)
        own = np.arange(65_536)
        cls = np.where(own >= WHOLE, own - WHOLE, np.maximum(own - RARE, 0))
        cls[: len(words)] = [c % CLASSES for c in self.codes.values()]
        base = np.zeros(65_536)
        base[: len(words)] = np.log(10) * self.log_count - np.log(self.in_class[cls[: len(words)]])
        self.groups = 1 << max(0, (3 * self.total // GROUP_KEYS).bit_length())
        self.slots = max(self.groups, min(MAX_SLOTS, 1 << max(10, self.total.bit_length())))
        known = sc.broadcast({"codes": self.codes})
        grams = word_grams(docs, known, self.groups)
        shards = materialize(word_table(grams, {"word": base, "class": cls}, self.log_class, self.groups, self.slots), "word-features")
        self.table = hash_table(shards.toLocalIterator(), self.groups, self.slots)  # a part at a time

    def shared(self) -> tuple:
        import numpy as np

        return self.codes, self.log_class, np.log10(self.in_class), self.log_count, self.table, self.groups


def score(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    import numpy as np

    model = Model(docs, steps)
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())

    def run(batches):
        known, log_class, log_in_class, log_count, table, groups = shared.value
        codes = Codes(known)
        codes.most = len(known) + Codes.most
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        for batch in batches:
            docs_words = [[*words_of(t), END] for t in batch.column(2).to_pylist()]
            if not docs_words:
                continue
            code, one, two, length = coded(docs_words, codes)
            each = log_lifts(code, one, two, log_class, table, groups) / math.log(10) - log_in_class[code % CLASSES]
            number = code // CLASSES
            frequent = number < 65_536
            logs = np.where(frequent, log_count[np.where(frequent, number, 0)], 0.0)
            first = np.cumsum(length) - length
            rare, times = [], []
            for words, low, n in zip(docs_words, first.tolist(), length.tolist()):
                others: dict = {}
                for k in np.flatnonzero(~frequent[low : low + n]).tolist():
                    w = words[k]
                    others[w] = others.get(w, 0) + 1
                rare.append(list(others))
                times.append(list(others.values()))
            sums = (length, np.add.reduceat(frequent.astype(np.int64), first), np.add.reduceat(logs, first), np.add.reduceat(each, first), rare, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(sums, kinds)]],
                ["doc_id", "held_out", "n_tokens", "n_frequent", "log_frequent", "log_lifts", "rare", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, log_lifts double, rare array<binary>, times array<int>"
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored-parts")
    others = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("t"))
    log_n = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))
    summed = others.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("t") * log_n).alias("log_rare"), F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("n_rare")
    )
    all_log = F.col("log_frequent") + F.coalesce("log_rare", F.lit(0.0))
    norm = math.log10(model.total + ALPHA * (model.vocabulary + 1))
    # with no training text a frequent word has no count either
    n_known = F.col("n_frequent") if model.total else F.lit(0)
    return rows.drop("rare", "times").join(summed, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (n_known + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (all_log - F.col("n_tokens") * norm).alias("base_score"),
        (all_log + F.col("log_lifts")).alias("score"),
    )


def class_sizes(counts: DataFrame) -> DataFrame:
    """class, tokens, words: sums over all training words. Tasks sum before the shuffle."""

    def run(batches):
        import numpy as np

        tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            if batch.num_rows:
                cls = np.fromiter(map(class_of, batch.column(0).to_pylist()), np.int64, batch.num_rows)
                np.add.at(tokens, cls, batch.column(1).to_numpy())
                words += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(words)], ["class", "tokens", "words"])

    return counts.mapInArrow(run, "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words"))


def op10_language_model(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
