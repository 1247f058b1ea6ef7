"""Encoding of unbounded input: the row-wise operators run unchanged; longest-padding is per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import byte_level_pretokens
from ..operators.encode import pad, prepare
from ..plans.options import EncodeOptions, Family, Padding


def pretoken_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.withColumn("pretokens", byte_level_pretokens(F.col(text)))


def encode_stream(stream: DataFrame, ids: str, options: EncodeOptions, family: Family, sink: Callable[[DataFrame, int], None], checkpoint: str, pad_id: int = 0, **special: int) -> StreamingQuery:
    """Prepare each micro-batch and hand it to the sink. Padding to the longest takes the micro-batch as the batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ready = prepare(batch.withColumn("_batch", F.lit(0)), ids, options, family, pad_id=pad_id, batch="_batch" if options.padding == Padding.LONGEST else None, **special)
        sink(ready.drop("_batch"), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FRAME = 1024  # rows that leave at once
STATE = "batch long, rows array<string>, ids array<array<int>>, times array<long>"
BATCH = "lane long, batch long, row string, input_ids array<int>, attention_mask array<int>"


def batch_stream(stream: DataFrame, lane: Column, row: str, ids: str, time: str, size: int, wait: float = 0.0, delay: str = "0 seconds", pad_id: int = 0) -> DataFrame:
    """Batches of ``size`` rows that fill over as many micro-batches as it takes: lane, batch, row, input_ids and attention_mask, padded to the longest of the batch.

    Each lane (a number; lanes share the work) fills its batches one after the other, by time and then row within a micro-batch. Rows that wait are kept in the
    state store, so a restarted stream goes on where it stopped, and a lane holds fewer than ``size`` of them. A batch that is not full goes out once the
    watermark (the latest time less ``delay``) is more than ``wait`` seconds past its first row. A row that comes when the watermark (at first the epoch)
    has passed its time is late, and Spark drops it: delay must cover what may come late. A null row of ids is empty.

    A task holds the ids of what a lane gets in one micro-batch, as arrays of four bytes an id, since they are put in order there; batches leave a few at a time.
    """

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, rows, own, times = (0, [], [], [])
        if state.exists:
            batch, rows, own, times = state.get
            rows, own, times = list(rows), [np.array(x, dtype=np.int32) for x in own], list(times)
        late = state.hasTimedOut
        if not late:
            more = [(p.time_.astype("datetime64[us]").astype("int64").to_numpy() // 1000, p.row_.tolist(), [np.array([] if x is None else x, dtype=np.int32) for x in p.ids_]) for p in parts]
            at, names, new = np.concatenate([x[0] for x in more]), [r for x in more for r in x[1]], [i for x in more for i in x[2]]
            order = sorted(range(len(names)), key=lambda k: (at[k], names[k] is None, names[k] or ""))
            rows, times, own = rows + [names[k] for k in order], times + at[order].tolist(), own + [new[k] for k in order]
        full, begin, out = len(rows) // size, 0, []
        for n in [size] * full + ([len(rows) - size * full] if late and len(rows) > size * full else []):
            ids = own[begin : begin + n]
            longest = max(map(len, ids))
            for r, x in zip(rows[begin : begin + n], ids, strict=True):
                padded, mask = np.full(longest, pad_id, dtype=np.int32), np.zeros(longest, dtype=np.int32)
                padded[: len(x)], mask[: len(x)] = x, 1
                out.append((key[0], batch, r, padded, mask))
            own[begin : begin + n] = [None] * n  # has left
            batch, begin = batch + 1, begin + n
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=["lane", "batch", "row", "input_ids", "attention_mask"])
                out = []
        rows, own, times = rows[begin:], own[begin:], times[begin:]
        state.update((batch, rows, [x.tolist() for x in own], times))
        if rows:
            state.setTimeoutTimestamp(max(int(times[0] + 1000 * wait), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["lane", "batch", "row", "input_ids", "attention_mask"])

    rows = stream.select(lane.cast("long").alias("lane_"), F.col(row).cast("string").alias("row_"), F.col(ids).cast("array<int>").alias("ids_"), F.col(time).cast("timestamp").alias("time_"))
    return rows.withWatermark("time_", delay).groupBy("lane_").applyInPandasWithState(fill, BATCH, STATE, "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["batch_stream", "encode_stream", "pad", "pretoken_stream"]
