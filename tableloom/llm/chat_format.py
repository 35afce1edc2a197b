"""Chat formatting by quotation linking (DataFrame functions only).

A message's lines are parsed for nested quote marks, ``>`` once per level. Runs of lines of one level
are passages; a passage, its paragraphs and its lines are normalised (lower case, single spaces) and
hashed. The messages' own texts are hashed the same way and pre-aggregated to one row for each hash
(and for each hash in a conversation), the earliest message, so the join to the originals never
pairs up the messages that share a common line. A quoting message replies to the original of the
match at the lowest quote level, of these the longest: the earliest message before it in its own
conversation, else the earliest before it in (conv_id, turn) order anywhere. So a deeper passage links
where none above it has an original. A thread's first message is found by pointer doubling; within a
thread a message comes before its replies, which follow in their own order, each with its replies. That order
comes from ranking the walk around each tree as a linked list, so rows keep one size however deep a thread is.

Defined results: null text counts as empty and stays empty; a message without quote marks keeps its text
as it is and is ordered by its turn; a quotation without an original is removed all the same; units
shorter than ``MIN_CHARS`` link only as a whole passage; repeated rows each have a row; messages with
a null conv_id or turn link to nothing and nothing links to them; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import delete
from .common import materialize

MARK = r"^(?:[ \t]*>)+"
#: A line that introduces a quotation, dropped if a quoted line follows it.
INTRODUCES = r"(?i)^\s*(on\b.*\bwrote|.+\b(wrote|schrieb|a écrit|escribió))\s*:\s*$"
MIN_CHARS = 12


def normalised(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words only), quote_depth, passages (level, text) of quotations.

    All within the row: a message never leaves its task.
    """
    whole = F.coalesce("text", F.lit(""))
    lines = F.transform(
        F.split(whole, "\r?\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"),
            F.trim(F.regexp_replace(x, MARK, "")).alias("body"),
            x.alias("raw"),
        ),
    )
    level = lambda i: F.get("lines", i)["level"]
    rows = messages.select("conv_id", "turn", "role", whole.alias("old"), lines.alias("lines"))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["raw"].rlike(INTRODUCES) & (F.coalesce(level(i + 1), F.lit(0)) > 0)))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.select("*", F.array_max(F.transform("lines", lambda x: x["level"])).alias("quote_depth"))
    rows = rows.withColumn("starts", F.when(F.col("quote_depth") > 0, starts).otherwise(F.array().cast("array<int>")))
    runs = F.transform(
        "starts",
        lambda s, k: F.struct(
            level(s).alias("level"),
            F.array_join(
                F.transform(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), lambda x: x["body"]), "\n"
            ).alias("text"),
        ),
    )
    text = F.when(F.col("quote_depth") > 0, F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"^\s+|\s+\z", "")).otherwise(F.col("old"))
    return rows.select(
        "conv_id", "turn", "role", text.alias("text"), "quote_depth", F.filter(runs, lambda r: r["level"] > 0).alias("passages")
    )


def units(c: Column) -> Column:
    """The distinct (hash, chars, whole) of a text, its paragraphs and its lines."""
    parts = F.concat(F.array(c), F.split(c, r"\n\s*\n"), F.split(c, r"\n"))
    clean = F.array_distinct(F.transform(parts, normalised))
    kept = F.filter(clean, lambda x: (F.length(x) >= MIN_CHARS) | ((x == normalised(c)) & (F.length(x) > 0)))
    return F.transform(kept, lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.length(x).alias("chars")))


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_conv, reply_turn: one row for each (conv_id, turn) that replies."""
    known = messages.where("conv_id is not null and turn is not null")
    quoted = known.where("quote_depth > 0").select("conv_id", "turn", F.explode("passages").alias("p"))
    quoted = quoted.select("conv_id", "turn", "p.level", F.explode(units(F.col("p.text"))).alias("u"))
    quoted = quoted.groupBy("conv_id", "turn", F.col("u.hash").alias("hash"), F.col("u.chars").alias("chars")).agg(F.min("level").alias("level"))
    quoted = materialize(quoted, "quoted-units")
    own = known.select("conv_id", "turn", F.explode(units(F.col("text"))).alias("u")).select("conv_id", "turn", F.col("u.hash").alias("hash"))
    own = own.join(materialize(quoted.select("hash").distinct(), "quoted-hashes"), "hash", "left_semi")
    # tables of their own, so that the joins can split a line that very many messages quote
    here = materialize(own.groupBy("hash", "conv_id").agg(F.min("turn").alias("here")), "originals-here")
    there = materialize(here.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("o")), "originals")
    met = quoted.join(here, ["hash", "conv_id"], "left").join(there, "hash", "left")
    me = F.struct("conv_id", "turn")
    original = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(F.col("o") < me, F.col("o"))
    found = met.select("conv_id", "turn", "level", "chars", original.alias("original")).where("original is not null")
    # the lowest level, then the longest match; of equal ones the same conversation, then the earliest
    rank = F.struct(-F.col("level"), "chars", (F.col("original.conv_id") == F.col("conv_id")).alias("same"), -F.col("original.conv_id"), -F.col("original.turn"))
    best = found.groupBy("conv_id", "turn").agg(F.max_by("original", rank).alias("original"))
    return best.select("conv_id", "turn", F.col("original.conv_id").alias("reply_conv"), F.col("original.turn").alias("reply_turn"))


def in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds at, gapless from 0 in the order of ``columns``: a distributed sort, then counts of the partitions before."""
    rows = rows.orderBy(*columns).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows, "in-order")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "low", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(counts), "part").withColumn("at", F.col("at") - F.col("low") + F.col("before")).drop("part", "low", "before")


def thread_roots(edges: DataFrame) -> DataFrame:
    """node, root, depth for each row of ``edges`` (node, up).

    Every step doubles the distance looked back, so a chain of n replies takes log2(n) joins of rows of one size. A reply
    comes after its original in (conv_id, turn) order, so there are no cycles.
    """
    state = materialize(edges.select("node", "up", F.lit(1).alias("depth"), F.lit(False).alias("done")), "thread-roots")
    while not (live := state.where("not done")).isEmpty():
        above = state.select(F.col("node").alias("a_node"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("done").alias("a_done"))
        moved = live.join(above, F.col("up") == F.col("a_node"), "left").select(
            "node", F.coalesce("a_up", "up").alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"), F.coalesce("a_done", F.lit(True)).alias("done")
        )
        state, old = materialize(state.where("done").unionByName(moved), "thread-roots"), state
        delete(state.sparkSession, old.kept_at)
    return state.select("node", F.col("up").alias("root"), "depth")


def preorder(edges: DataFrame) -> DataFrame:
    """node, place for each row of ``edges`` (node, up): places rise in the order of a tree's walk, each message before
    its replies, those in the order of their nodes.

    The walk is a list that enters and leaves each node; the length of what is left of it is found by doubling, so
    deep and broad threads alike take as many joins as their size has binary digits, on unique keys.
    """
    sorted_ = in_order(edges.select("up", "node"), ["up", "node"])
    after = sorted_.select((F.col("at") - 1).alias("at"), F.col("up").alias("n_up"), F.col("node").alias("sibling"))
    sibling = F.when(F.col("n_up") == F.col("up"), F.col("sibling"))
    children = sorted_.join(after, "at", "left").select("node", "up", sibling.alias("sibling"))
    first = edges.groupBy("up").agg(F.min("node").alias("child")).withColumnRenamed("up", "parent")
    end = lambda node, side: F.struct(F.col(node).alias("node"), F.lit(side).alias("side"))
    nodes = edges.select("node").union(edges.select("up")).distinct().join(first, F.col("node") == F.col("parent"), "left")
    enters = nodes.select(end("node", 0).alias("e"), F.when(F.col("child").isNotNull(), end("child", 0)).otherwise(end("node", 1)).alias("next"), F.lit(1).cast("long").alias("left"))
    leaves = children.select(end("node", 1).alias("e"), F.when(F.col("sibling").isNotNull(), end("sibling", 0)).otherwise(end("up", 1)).alias("next"), F.lit(0).cast("long").alias("left"))
    state = materialize(enters.unionByName(leaves), "walk")  # to leave a root is the end of its list, which has no row
    while not (live := state.where("next is not null")).isEmpty():
        ahead = state.select(F.col("e").alias("a_e"), F.col("next").alias("a_next"), F.col("left").alias("a_left"))
        moved = live.join(ahead, F.col("next") == F.col("a_e"), "left").select("e", F.col("a_next").alias("next"), (F.col("left") + F.coalesce("a_left", F.lit(0))).alias("left"))
        state, old = materialize(state.where("next is null").unionByName(moved), "walk"), state
        delete(state.sparkSession, old.kept_at)
    return state.where("e.side = 0").select(F.col("e.node").alias("node"), (-F.col("left")).alias("place"))


def reply_places(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_conv, thread_turn (of the thread's first message), reply_depth, place: for each reply."""
    edges = links.select(F.struct("conv_id", "turn").alias("node"), F.struct(F.col("reply_conv").alias("conv_id"), F.col("reply_turn").alias("turn")).alias("up"))
    edges = materialize(edges, "reply-edges")
    found = thread_roots(edges).join(preorder(edges), "node")
    return found.select("node.conv_id", "node.turn", F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.col("depth").alias("reply_depth"), "place")


def placed(rows: DataFrame) -> DataFrame:
    """Adds position, gapless from 0 within thread_conv in the order of thread_turn, place and key; a key that repeats takes
    as many. A thread of any size is spread over partitions."""
    rows = in_order(rows, ["thread_conv", "thread_turn", "place", "key"])
    first = rows.groupBy(F.col("thread_conv").alias("t")).agg(F.min("at").alias("first"))
    rows = rows.join(first, F.col("thread_conv").eqNullSafe(F.col("t"))).withColumn("position", F.col("at") - F.col("first"))
    return rows.drop("t", "first", "at")


def message_key() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat_ws("|", text("conv_id"), text("turn"), F.hex(F.xxhash64("role", "text")))


def with_few(rows: DataFrame, side: DataFrame, most: int = 100_000) -> DataFrame:
    """Left join on (conv_id, turn); a side of at most ``most`` rows, which is counted, is broadcast."""
    small = side.limit(most + 1).count() <= most
    return rows.join(F.broadcast(side) if small else side, ["conv_id", "turn"], "left")


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, text without quotations, quote_depth,
    reply_conv, reply_turn, thread_conv, reply_depth and position in the thread.

    Order is found on keys alone; texts move once, to meet their places. Repeated rows meet before
    that move.
    """
    rows = parsed(messages)
    links = materialize(reply_links(rows), "reply-links")
    threads = materialize(reply_places(links), "reply-places")
    keyed = rows.select(message_key().alias("key"), "conv_id", "turn")
    keyed = with_few(with_few(keyed, links), threads)
    # what replies to nothing comes first in a thread of its own
    first = F.col("place").isNull()
    keyed = keyed.select(
        "key", "reply_conv", "reply_turn", *[F.when(first, F.col(own)).otherwise(F.col(c)).alias(c) for c, own in (("thread_conv", "conv_id"), ("thread_turn", "turn"))],
        F.coalesce("reply_depth", F.lit(0)).alias("reply_depth"), F.coalesce("place", F.lit(-(2**62))).alias("place"),
    )
    places = placed(keyed).groupBy("key", "reply_conv", "reply_turn", "thread_conv", "reply_depth").agg(
        F.min("position").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    held = rows.select(message_key().alias("key"), "conv_id", "turn", "role", "text", "quote_depth")
    held = held.groupBy("key").agg(*(F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text", "quote_depth")))
    out = held.join(places, "key").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.withColumn("position", F.col("first") + F.col("nth")).drop("key", "first", "copies", "nth")


def op4_chat_format(spark, sf_dir):
    out = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", "text", "quote_depth", "reply_conv", "reply_turn", "thread_conv", "reply_depth", "position")


#: For tables whose (conv_id, turn) are unique and not null.
ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS old, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
line AS (SELECT conv_id, turn, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM raw),
marked AS (SELECT *, len(regexp_replace(regexp_extract(l, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, trim(regexp_replace(l, '^(?:[ \t]*>)+', '')) AS body FROM line),
flow AS (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS after FROM marked WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM flow),
own AS (SELECT conv_id, turn, max(level) AS depth, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(after, 0) > 0
  AND regexp_matches(l, '(?i)^\s*(on\b.*\bwrote|.+\b(wrote|schrieb|a écrit|escribió))\s*:\s*$'))), '') AS text FROM runs GROUP BY 1, 2),
m AS (SELECT raw.conv_id, raw.turn, role, CASE WHEN depth > 0 THEN regexp_replace(own.text, '^\s+|\s+$', '', 'g') ELSE old END AS text, CAST(depth AS INT) AS quote_depth
  FROM raw JOIN own ON raw.conv_id = own.conv_id AND raw.turn = own.turn),
passages AS (SELECT conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS text FROM runs WHERE level > 0 GROUP BY 1, 2, 3, 4),
whole AS (SELECT conv_id, turn, text, 0 AS quoted FROM m UNION ALL SELECT conv_id, turn, text, level FROM passages),
part AS (SELECT conv_id, turn, quoted, text AS whole, unnest(list_concat(list_concat([text], regexp_split_to_array(text, '\n\s*\n')), string_split(text, chr(10)))) AS u FROM whole),
unit AS (SELECT DISTINCT conv_id, turn, quoted, lower(trim(regexp_replace(u, '\s+', ' ', 'g'))) AS u, lower(trim(regexp_replace(whole, '\s+', ' ', 'g'))) AS w FROM part),
good AS (SELECT DISTINCT conv_id, turn, quoted, u FROM unit WHERE len(u) >= 12 OR (u = w AND len(u) > 0)),
pairs AS (SELECT q.conv_id, q.turn, q.quoted AS level, len(q.u) AS chars, o.conv_id AS oc, o.turn AS ot FROM good q JOIN good o ON q.u = o.u AND o.quoted = 0 AND (o.conv_id, o.turn) < (q.conv_id, q.turn) WHERE q.quoted > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, oc = conv_id DESC, oc, ot) AS rn FROM pairs),
reply AS (SELECT conv_id, turn, oc, ot FROM best WHERE rn = 1),
walk(conv_id, turn, path, thread, depth) AS (
  SELECT conv_id, turn, [{'c': conv_id, 't': turn}], conv_id, 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM reply r WHERE r.conv_id = m.conv_id AND r.turn = m.turn)
  UNION ALL SELECT r.conv_id, r.turn, list_append(path, {'c': r.conv_id, 't': r.turn}), thread, depth + 1 FROM walk JOIN reply r ON r.oc = walk.conv_id AND r.ot = walk.turn)
SELECT m.conv_id, m.turn, m.role, m.text, quote_depth, oc AS reply_conv, ot AS reply_turn, thread AS thread_conv, CAST(depth AS INT) AS reply_depth,
  row_number() OVER (PARTITION BY thread ORDER BY path) - 1 AS position
FROM m JOIN walk ON walk.conv_id = m.conv_id AND walk.turn = m.turn LEFT JOIN reply ON reply.conv_id = m.conv_id AND reply.turn = m.turn"""
