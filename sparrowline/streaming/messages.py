"""Messages that grow while their events arrive.

A trigger stores its events only, under its number, so a trigger that is run again replaces
its own and storage grows with the replies, not with their squares. Stored events and what
has been folded from older ones are pieces of messages: text, other events, and the range of
places they cover. Reading folds the pieces; now and then they are folded for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowline.operators.messages import message_upsert, other_event
from sparrowline.session import path_exists, table_exists

# Stored events and pieces lie in this many parts of the sessions.
BUCKETS = 16
_EVENT = "struct<name:string,data:string,at:bigint>"


def as_pieces(events: DataFrame, session: str = "session_id", seq: str = "seq", at: str = "at") -> DataFrame:
    """``(session, first, last, content, events, latest)``: a piece for each event of
    :func:`read_client_events` that adds to a message."""
    other = other_event()
    event = F.struct("name", "data", F.col(at).cast("bigint").alias("at")).cast(_EVENT)
    place = F.col(seq).cast("bigint")
    return events.filter(F.col("token").isNotNull() | other).select(
        session,
        place.alias("first"),
        place.alias("last"),
        F.coalesce("token", F.lit("")).alias("content"),
        F.when(other, F.array(event)).otherwise(F.array().cast(f"array<{_EVENT}>")).alias("events"),
        F.when(other, F.concat("name", F.lit(": "), F.col("summary"))).alias("latest"),
    )


def fold_pieces(pieces: DataFrame, session: str = "session_id") -> DataFrame:
    """Neighbouring pieces of a session in one; what was stored before is left out.

    Pieces never overlap in part: one that was sent twice lies within the other.
    """
    ordered = Window.partitionBy(session).orderBy("first", F.desc("last"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(before), F.lit(-1).cast("bigint"))
    new = pieces.withColumn("_reach", reach).filter(F.col("_reach") < F.col("first"))
    starts = (F.col("first") != F.col("_reach") + 1).cast("bigint")
    placed = new.withColumn("_run", F.sum(starts).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(placed, session, "_run").drop("_run")


def _joined(pieces: DataFrame, *keys: str) -> DataFrame:
    lists = F.array_sort(F.collect_list(F.struct("first", "events")))
    return pieces.groupBy(*keys).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.expr("listagg(content, '') within group (order by first)").alias("content"),
        F.flatten(F.transform(lists, lambda piece: piece["events"])).alias("events"),
        F.max_by("latest", F.when(F.col("latest").isNotNull(), F.col("first"))).alias("latest"),
    )


def _folded_up_to(spark: SparkSession, path: str) -> int:
    """The last trigger whose events are folded; -1 if none are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pieces")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    numbers = sorted((int(name.partition("=")[2]) for name in names), reverse=True)
    return next((n for n in numbers if table_exists(spark, f"{path}/pieces/upto={n}")), -1)


def _pieces(spark: SparkSession, path: str, most: int | None = None) -> DataFrame | None:
    """All stored pieces, up to a trigger; ``None`` where nothing is stored."""
    upto, found = _folded_up_to(spark, path), None
    if upto >= 0:
        found = spark.read.parquet(f"{path}/pieces/upto={upto}")
    if path_exists(spark, f"{path}/events"):
        later = spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events").filter(F.col("batch") > upto)
        later = (later if most is None else later.filter(F.col("batch") <= most)).drop("batch")
        found = later if found is None else found.unionByName(later)
    return found


def compact_messages(spark: SparkSession, path: str, upto: int, session: str = "session_id") -> None:
    """Fold what triggers up to ``upto`` have stored; a fold that was killed is not seen."""
    pieces = _pieces(spark, path, upto)
    folded = fold_pieces(pieces.drop("bucket"), session)
    _store(folded, f"{path}/pieces/upto={upto}", session)


def _store(pieces: DataFrame, path: str, session: str) -> None:
    bucket = F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")
    pieces.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)


def save_messages(
    events: DataFrame, path: str, checkpoint: str, session: str = "session_id", seq: str = "seq", at: str = "at"
) -> StreamingQuery:
    """Store every trigger's events below ``path`` until the input that is there is used up.

    After trigger 1, 2, 4, 8 and so on, all that is stored is folded: each fold is about
    twice the one before, so they take no more than twice the whole together.
    """

    def save(batch: DataFrame, number: int) -> None:
        _store(as_pieces(batch, session, seq, at), f"{path}/events/batch={number}", session)
        if number & (number + 1) == 0 and number:
            compact_messages(batch.sparkSession, path, number, session)

    return (
        events.writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_messages(spark: SparkSession, path: str, session: str = "session_id") -> DataFrame:
    """``(session, content, events, latest)``: every session's message as it stands now.

    ``latest`` is the text of the last event that is no token, ``''`` before there is one.
    """
    pieces = _pieces(spark, path)
    if pieces is None:
        raise ValueError(f"no messages are stored at {path}")
    whole = _joined(fold_pieces(pieces.drop("bucket"), session), session)
    return whole.select(session, "content", "events", F.coalesce("latest", F.lit("")).alias("latest"))


def upsert_live(history: DataFrame, live: DataFrame, replies: DataFrame, session: str = "session_id") -> DataFrame:
    """The messages of ``history`` with the live ones in their place, or added to it.

    ``replies`` has ``(session, timestamp)`` of the reply each live message belongs to. An
    assistant message with that time is replaced; a new one is added once it has text or
    events, as :func:`message_upsert` does.
    """
    updates = live.join(replies.select(session, "timestamp"), session).select(
        session,
        F.lit("assistant").alias("role"),
        "timestamp",
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(True).alias("ensure_create"),
        "content",
        "events",
    )
    return message_upsert(history, updates, session, values=("content", "events"))
