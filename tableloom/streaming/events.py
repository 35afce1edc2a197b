"""Event time: windows of inputs, and batches that can be run again."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import incremental


def event_time_window(df: DataFrame, column: str | None, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= time < end; an input without an event time is read whole.

    The bounds are literals, so the filter reaches the Parquet scan.
    """
    if column is None:
        return df
    kind = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast(kind))
    return df


def windowed(inputs: Mapping[str, DataFrame], event_times: Mapping[str, str], start: str, end: str) -> dict[str, DataFrame]:
    return {name: event_time_window(df, event_times.get(name), start, end) for name, df in inputs.items()}


def run_microbatch(
    spark: SparkSession, model: Callable[..., DataFrame], inputs: Mapping[str, DataFrame], event_times: Mapping[str, str],
    start: str, end: str, name: str, key: str | Sequence[str],
) -> DataFrame:
    """Run a model on one window of its inputs and merge the result into its table by key.

    The key makes a second run over the same window change nothing.
    """
    batch = model(**windowed(inputs, event_times, start, end))
    return incremental.build_incremental(spark, name, batch, "microbatch", key)


def _version(columns: Sequence[str], event_time: str) -> Column:
    """What orders the versions of a key: the event time (none is the earliest), then a hash of the whole row."""
    return F.struct(F.col(event_time).alias("at"), F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]).alias("tie"))


def latest_versions(rows: DataFrame, key: str | Sequence[str], event_time: str) -> DataFrame:
    """The latest row of each key by event time; the order in which rows come has no say. Rows without a whole key all stay.

    A maximum by key, so repeats of a hot key are combined before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keyed = rows.dropna(subset=keys)
    latest = keyed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct("*"), _version(rows.columns, event_time)).alias("row"))
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    return latest.select("row.*").unionByName(rows.where(~whole))


def newer_than(target: DataFrame, batch: DataFrame, key: str | Sequence[str], event_time: str) -> DataFrame:
    """The batch rows (one for each key) that are later than the target's row of that key, or have none there.

    The target is read for its versions of the batch's keys; a batch that is counted to be small is broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [c for c in batch.columns if c in target.columns]
    few = batch.limit(incremental.FEW_ROWS + 1).count() <= incremental.FEW_ROWS
    small = F.broadcast if few else (lambda df: df)
    asked = batch.dropna(subset=keys).select(*keys)
    held = target.join(small(asked), keys, "left_semi").groupBy(*keys).agg(F.max(_version(columns, event_time)).alias("__held"))
    both = batch.join(small(held), keys, "left")
    return both.where(F.col("__held").isNull() | (_version(columns, event_time) > F.col("__held"))).select(*batch.columns)


def merge_stream(stream: DataFrame, name: str, key: str | Sequence[str], checkpoint: str, event_time: str | None = None, watermark: str | None = None):
    """Merge a stream into a table by key, a micro-batch at a time. Returns the started query; what is there is worked
    off, then it stops.

    With ``event_time`` the latest version of a key stands in the end, whatever the order, the batches and the replays
    it comes in: a batch is cut to its latest versions, and these to what is later than the table's. Ties go by
    a hash of the row. Rows with a null in the key are appended as they come, and only the checkpoint keeps them from coming
    twice. Without ``event_time`` a key that repeats within a batch is an error, as its last row would be a matter
    of chance.

    ``watermark`` (such as '2 days', on a timestamp) keeps rows of that span as state, so that repeats of whole rows go before the
    merge, and bounds that state: rows that are later than it are dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if watermark:
        stream = stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(stream.columns)

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = session.materialize(batch, "micro-batch")
        try:
            if event_time:
                rows = latest_versions(held, keys, event_time)
                if incremental.is_incremental(spark, name):
                    rows = newer_than(spark.table(name), rows, keys, event_time)
            elif incremental.repeated_keys(held, keys).isEmpty():
                rows = held
            else:
                raise incremental.DuplicateKeys(f"keys {keys} repeat within a micro-batch")
            incremental.build_incremental(spark, name, rows, "microbatch", keys)
        finally:
            session.delete(spark, held.kept_at)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
