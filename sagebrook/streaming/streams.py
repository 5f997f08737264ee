"""Structured Streaming: message deltas, windows over events, states, ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch

DELTAS = "message_id string, seq int, delta string, last boolean"


def reassembled(deltas: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """(message_id, text) of each message once all its deltas have come, in whatever order.

    With `wait_ms`, for streams that run on, pieces of a message for which nothing has come for so
    long are given up, so that state doesn't grow with messages that are never finished. A run
    over what is there now would wait for such timers for ever and takes none.
    """

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, parts, end = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], -1)
        for b in batches:
            seqs += [int(x) for x in b["seq"]]
            parts += b["delta"].tolist()
            if b["last"].any():
                end = int(b.loc[b["last"], "seq"].max())
        if end >= 0 and len(set(seqs)) == end + 1:
            by = dict(zip(seqs, parts))
            if state.exists:
                state.remove()
            yield pd.DataFrame({"message_id": [key[0]], "text": ["".join(by[i] for i in range(end + 1))]})
        else:
            state.update((seqs, parts, end))
            if wait_ms:
                state.setTimeoutDuration(wait_ms)

    return deltas.groupBy("message_id").applyInPandasWithState(collect, "message_id string, text string", "seqs array<int>, parts array<string>, last_seq int", "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)


def as_events(finished: DataFrame, sources: DataFrame, validate: Callable[[DataFrame], DataFrame], piece: int = 1000) -> DataFrame:
    """The event protocol of answers: start with what is known before, text-start, text-delta for each piece, text-end, and finish with the validation.

    finished: message_id, text; sources: message_id, metadata. event_no counts a message's events from 0.
    """
    row = lambda df, no, event, payload: df.select("message_id", no.alias("event_no"), F.lit(event).alias("event"), payload.alias("payload"))
    n = F.greatest(F.ceil(F.length("text") / piece).cast("int"), F.lit(1))
    cut = finished.select("message_id", "text", n.alias("n"))
    pieces = cut.select("message_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))).alias("i", "piece"))
    none = F.lit(None).cast("string")
    ends = validate(finished).select("message_id", "payload").join(cut.select("message_id", "n"), "message_id")
    parts = [
        row(sources, F.lit(0), "start", F.col("metadata")), row(cut, F.lit(1), "text-start", none), row(pieces, F.col("i") + 2, "text-delta", F.col("piece")),
        row(cut, F.col("n") + 2, "text-end", none), row(ends, F.col("n") + 3, "finish", F.col("payload")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Which states may follow a document's state.
FOLLOWING = {"pending": ("processing", "failed"), "processing": ("ready", "failed"), "ready": ("processing",), "failed": ("processing",)}


def allowed_change(old: Column, new: Column) -> Column:
    """Whether a document may pass from one state to another; a new document, with null for its old state, is pending."""
    ok = old.isNull() & (new == "pending")
    for state, following in FOLLOWING.items():
        ok = ok | (old == state) & new.isin(*following)
    return F.coalesce(ok, F.lit(False))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Rows and sums a tumbling window and event type, given out once the window is over for longer than `late`; later rows are dropped. An extension."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "append", columns: str | None = None) -> DataFrame:
    """Runs a stream over all there is now, exactly once, and reads what it wrote."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number % 2}")
        batch.sparkSession.createDataFrame([(number % 2,)], "side int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/last")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    side = spark.read.parquet(f"{folder}/last").first()[0]
    return spark.read.schema(stream.schema).parquet(f"{folder}/out-{side}")


def ingest(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Files that arrive in a folder, each taken once: transformed and appended, with its state kept for the next run."""
    source = spark.readStream.schema(schema).json(folder)
    transform(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
