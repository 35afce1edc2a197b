"""Line deduplication against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tableloom.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in line.strip(STRIP))


def brute(rows):
    """(doc_id, n_lines, n_dropped, sha) of rows whose ids are unique or null."""
    name = lambda d, t: (d is None, d if d is not None else 0, (t or "") if d is None else "")
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(name(d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 10 and min(holders[key_of(x)]) != name(d, t))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    out = line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("s"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    lines = ["", "  ", "short", "exactly 10", "Exactly 10 \x0b", "\texactly 10", "Ärger im Büro", "ärger im Büro", "a very common line"] + [f"line number {k} of them" for k in range(60)]
    rows = [(k, "\n".join(lines[j] for j in rng.integers(0, len(lines), rng.integers(1, 30)))) for k in range(150)]
    rows += [(200 + k, "a very common line\n" * 40 + f"own line of {k}") for k in range(80)]  # one line holds most rows
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "no line feed at the end"), (904, "no line feed at the end\n"), (-5, "no line feed at the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("late", "t", "keep", "lines", "h1", "pos", "n_lines")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert found(docs.repartition(5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hash_over_many_ranges_and_batches(spark):
    """The ranges of one hash know its first document, though they are streamed apart."""
    rows = [(k, "the one line of all") for k in range(1, 3001)]
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        records = line_dedup.line_records(spark.createDataFrame(rows, "doc_id long, text string"))
        marks = line_dedup.marked(records).collect()
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.kind == line_dedup.EDGE for r in marks) > 8
    assert sum(r.kind == line_dedup.WAITS for r in marks) < 40


def test_odd_rows(spark):
    long = "\n".join(f"line {k % 900} of a long text" for k in range(20_000))
    rows = [(None, "first shared line\nmine"), (None, "first shared line\nother"), (7, "second shared line"), (8, "second shared line"), (9, long), (10, long + "\nits own end")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_with_hash_order(spark, rows)
    again = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string")
    one = dict((r[0], r) for r in found(spark.createDataFrame(rows, "doc_id long, text string")) if r[0])
    assert all(r == one[r[0]] for r in found(again) if r[0])
    same_id = found(spark.createDataFrame([(1, "told by both rows"), (1, "told by both rows\nmore"), (2, "told by both rows")], "doc_id long, text string"))
    assert [r[:3] for r in same_id] == [(1, 1, 0), (1, 2, 0), (2, 1, 1)]
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def brute_with_hash_order(spark, rows):
    """Rows without an id come in the order of Spark's hash of the text."""
    texts = [t for d, t in rows if d is None]
    order = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.lit("no id"), "t").alias("h")).collect()}
    ids = {d for d, _ in rows if d is not None}
    renamed = {t: max(ids) + 1 + k for k, t in enumerate(sorted(texts, key=order.get))}
    got = brute([(renamed[t] if d is None else d, t) for d, t in rows])
    return sorted(((None if r[0] > max(ids) else r[0], *r[1:]) for r in got), key=repr)


def test_bitmaps_stand_for_texts(spark):
    docs = spark.createDataFrame([(1, "a line of many words\nx"), (2, "x\nA line of many words \ny"), (3, "nothing shared here")], "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(docs).collect()
    assert (row.doc, row.n_lines, row.n_dropped) == (2, 3, 1) and np.unpackbits(np.frombuffer(zlib.decompress(row.keep), np.uint8), count=3).tolist() == [1, 0, 1]
