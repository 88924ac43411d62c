"""Post-processing of object detections, frames as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_boxes(anchors: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(job, frame, x1, y1, x2, y2, class_id, score) of anchors(job, frame, cx, cy, w, h, scores array, scale_x, scale_y).

    Each anchor's best class counts if its score is above the threshold; centre and size become corners in the frame's scale.
    """
    a = anchors.withColumn("score", F.array_max("scores")).where(F.col("score") > threshold)
    corner = lambda c, size, sign, scale: (F.col(c) + sign * F.col(size) / 2) * F.col(scale)
    return a.select("job", "frame", corner("cx", "w", -1, "scale_x").alias("x1"), corner("cy", "h", -1, "scale_y").alias("y1"), corner("cx", "w", 1, "scale_x").alias("x2"), corner("cy", "h", 1, "scale_y").alias("y2"), (F.array_position("scores", F.col("score")) - 1).cast("int").alias("class_id"), "score")


def suppress(boxes: DataFrame, iou: float = 0.7) -> DataFrame:
    """Greedy suppression over all classes of a frame: the best box stays, boxes that overlap it by more than ``iou`` go, and so on.

    A frame's boxes are bounded by its anchors, so each frame is one small group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["score", "x1", "y1", "x2", "y2", "class_id"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        x1, y1, x2, y2 = (f[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        area, left, kept = (x2 - x1) * (y2 - y1), np.ones(len(f), bool), []
        for i in range(len(f)):
            if left[i]:
                kept.append(i)
                w = np.maximum(0, np.minimum(x2[i], x2) - np.maximum(x1[i], x1))
                h = np.maximum(0, np.minimum(y2[i], y2) - np.maximum(y1[i], y1))
                left &= w * h / (area[i] + area - w * h + 1e-6) <= iou
        return f.loc[kept]

    return boxes.groupBy("job", "frame").applyInPandas(run, boxes.schema)


def job_metrics(frames: DataFrame) -> DataFrame:
    """frames(job, frame, done, latency_ms): totals, mean latency of frames done, and progress."""
    g = frames.groupBy("job").agg(F.count("*").alias("n_frames"), F.count_if("done").alias("n_done"), F.round(F.avg(F.when(F.col("done"), F.col("latency_ms"))), 4).alias("mean_latency_ms"))
    return g.withColumn("progress", F.round(F.col("n_done") / F.col("n_frames"), 4))
