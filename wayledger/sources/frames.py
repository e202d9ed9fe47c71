"""Frame catalogues: still folders, stride sampling, rate thinning."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.screening import at
from ..operators.tracks import with_row_number
from ..session import materialise

# Fixed pattern: image suffixes a still folder is read for.
STILL = r"(?i)\.(jpg|jpeg|png|bmp)$"


def stills(spark: SparkSession, root: str, start: str | datetime, fps: float = 15.0) -> DataFrame:
    """Frames of still folders in filename order, timed from ``start``; pixels are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return number_stills(files, start, fps)


def number_stills(files: DataFrame, start: str | datetime, fps: float = 15.0) -> DataFrame:
    """Number files per folder. The listing is range-sorted by path and written once, which
    fixes an increasing position; blocks of positions are then numbered per folder."""
    named = files.filter(F.col("path").rlike(STILL)).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    ordered = materialise(named.orderBy("folder", "path").withColumn("_pos", F.monotonically_increasing_id()))
    numbered = with_row_number(ordered, ["folder"], "_pos").withColumnRenamed("_n", "frame_index").drop("_pos")
    micros = F.unix_micros(at(start)) + F.round(F.col("frame_index") * F.lit(1_000_000.0 / fps)).cast("bigint")
    return numbered.withColumn("ts", F.timestamp_micros(micros))


def every_nth(frames: DataFrame, stride: int) -> DataFrame:
    """Frames whose position is a multiple of the stride."""
    return frames.filter(F.col("frame_index") % max(1, stride) == 0)


def thinned(frames: DataFrame, target_fps: float, block_seconds: int = 600) -> DataFrame:
    """Frames at least ``1 / target_fps`` after the last kept frame of their camera.

    Which frames stay depends on the first one kept. Each time block first works out, for the
    few frames it could be entered at, the last frame it would keep; these summaries are
    chained per camera; then every block keeps its frames from its known entry. No task holds
    more than a block of frames or a camera's block summaries.
    """
    interval = 1_000_000.0 / target_fps
    size = block_seconds * 1_000_000
    rows = frames.withColumn("_t", F.unix_micros("ts")).withColumn("_slot", F.floor(F.col("_t") / size).cast("bigint"))

    def next_kept(t: np.ndarray) -> np.ndarray:
        # For each instant, the position of the first one at least an interval later.
        return np.searchsorted(t, t + interval, side="left")

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["_t"].to_numpy())
        after, leave = next_kept(t), t.copy()
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                leave[i] = leave[after[i]]
        start = float(pdf["_slot"].iloc[0]) * size
        n = min(len(t), int(np.searchsorted(t, start + interval, side="left")) + 1)
        return pd.DataFrame({"camera_id": pdf["camera_id"].iloc[0], "_slot": pdf["_slot"].iloc[0], "entry": t[:n], "leave": leave[:n]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = -np.inf, []
        for slot, block in pdf.sort_values(["_slot", "entry"]).groupby("_slot", sort=True):
            open_ = block[block["entry"] >= last + interval]
            if len(open_):
                out.append((block["camera_id"].iloc[0], slot, open_["entry"].iloc[0]))
                last = float(open_["leave"].iloc[0])
        return pd.DataFrame(out, columns=["camera_id", "_slot", "_entry"])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "frame_index"]).drop_duplicates("_t")
        t = pdf["_t"].to_numpy()
        after, i, kept = next_kept(t), int(np.searchsorted(t, pdf["_entry"].iloc[0])), []
        while i < len(t):
            kept.append(i)
            i = int(after[i])
        return pdf.iloc[kept][["camera_id", "_t", "frame_index"]]

    instants = rows.select("camera_id", "_slot", "_t", F.col("frame_index").cast("bigint").alias("frame_index"))
    summary = instants.groupBy("camera_id", "_slot").applyInPandas(entries, "camera_id string, _slot bigint, entry bigint, leave bigint")
    known = summary.groupBy("camera_id").applyInPandas(chain, "camera_id string, _slot bigint, _entry bigint")
    kept = instants.join(known, ["camera_id", "_slot"]).groupBy("camera_id", "_slot").applyInPandas(
        keep, "camera_id string, _t bigint, frame_index bigint"
    )
    return rows.join(kept, ["camera_id", "_t", "frame_index"], "left_semi").select(*frames.columns)
