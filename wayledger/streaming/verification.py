"""Ingest that verifies chains as it goes: a batch hashes its own new events and adds their segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import refdata as R
from ..operators import segments as S
from ..session import passing_dir, shuffles_dropped
from ..sources import events as ev
from . import live, partials

#: Folder inside a log that its readers pass over: segments of each batch.
SEGMENTS = "_segments"


def keep(spark: SparkSession, events_path: str, batch_key: str) -> None:
    """Add the segments of a batch's stored events; those of a log from before segments were kept are made once."""
    path = f"{events_path}/{SEGMENTS}"
    with shuffles_dropped(spark), passing_dir(spark) as place:
        if not partials.folders(spark, path):
            before = live.stored_events(spark, events_path)
            partials.add(S.segments_of(before.filter(before[live.BATCH] != batch_key), place), "before", path)
        partials.fold(spark, path, S.joined, but=batch_key)
        partials.add(S.segments_of(spark.read.parquet(f"{events_path}/{live.BATCH}={batch_key}"), place), batch_key, path)


def segments(spark: SparkSession, events_path: str) -> DataFrame:
    """The segments of all events of a log, from what its batches have added."""
    path = f"{events_path}/{SEGMENTS}"
    return S.joined(spark.read.schema(S.SEGMENTS).parquet(path))


def verdicts(spark: SparkSession, events_path: str, start: str | None = R.GENESIS) -> DataFrame:
    """One verdict per node, without reading an event."""
    return S.verdict(segments(spark, events_path), start)


def start(spark: SparkSession, inbox: str, events_path: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """As :func:`.live.start_ingest`, with segments kept beside the log. A batch that is applied again replaces its own."""
    run = live.run_of(spark, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        key = f"{run}-{number}"
        live.apply_batch(spark, batch, key, events_path)
        keep(spark, events_path, key)

    source = ev.read_envelopes(spark, inbox, stream=True, maxFilesPerTrigger=str(files_per_batch))
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
