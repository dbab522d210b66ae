"""Debounced requests: a request counts once its key has been quiet for a while, so of a burst the last one wins.

A request fires if its key has no other one, later by (at, seq), within ``wait`` seconds after it. ``debounced`` takes a
table, ``debounced_stream`` a stream; both fire the same requests, but the stream leaves out those that come
later than ``late`` allows. Requests without a time never fire; a null key is a key; other columns pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def debounced(requests: DataFrame, key: str, at: str, seq: str, wait: float) -> DataFrame:
    """The requests that fire.

    What is looked for lies at most ``wait`` ahead, so a key's requests are dealt out by spans of that time, and only the last one
    of a span asks when the next span begins: a key with very many requests is no single task.
    """
    micros = max(1, int(wait * 1_000_000))
    r = requests.where(F.col(at).isNotNull()).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_span", F.floor(F.col("_t") / F.lit(micros)))
    r = r.withColumn("_next", F.lead("_t").over(Window.partitionBy(key, "_span").orderBy("_t", seq)))
    begins = r.groupBy(F.col(key).alias("_key"), (F.col("_span") - 1).alias("_before")).agg(F.min("_t").alias("_begin"))
    r = r.join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_before")) & F.col("_next").isNull(), "left")
    return r.where(F.coalesce(F.coalesce("_next", "_begin") - F.col("_t") > micros, F.lit(True))).select(*requests.columns)


def _decide(held: list[list], wait: int, passed: int) -> tuple[list[str], list[list]]:
    """(rows that fire, what is still held) of requests [time, seq, row] when all up to the time ``passed`` are there."""
    held = sorted(held, key=lambda r: r[:2])
    fire, left = [], []
    for r, after in zip(held, [*held[1:], None], strict=True):
        row = None if after is not None and after[0] - r[0] <= wait else r[2]
        if r[0] + wait >= passed:
            left.append([r[0], r[1], row])  # its time still tells earlier ones that come late
        elif row is not None:
            fire.append(row)
    return fire, left


def debounced_stream(requests: DataFrame, key: str, at: str, seq: str, wait: float, late: str = "10 seconds") -> DataFrame:
    """The same of a stream, each request when event time, less ``late``, has passed its quiet time: a timer of its key tells.

    at is a timestamp, seq a whole number. A key's state has the requests of the last ``wait`` and ``late`` seconds only,
    and without the contents of those that a later one has overtaken.
    """
    micros = max(1, int(wait * 1_000_000))

    def fire(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for f in frames:
            held += [[int(t), int(s), r] for t, s, r in zip(f["_t"], f["_seq"], f["_row"], strict=True)]
        rows, held = _decide(held, micros, state.getCurrentWatermarkMs() * 1000)
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp((held[0][0] + micros) // 1000 + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame({"row": rows})

    r = requests.where(F.col(at).isNotNull()).withWatermark(at, late)
    r = r.select(F.to_json(F.struct(key)).alias("_key"), F.col(at), F.unix_micros(at).alias("_t"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("_seq"), F.to_json(F.struct(*requests.columns), JSON).alias("_row"))
    fired = r.groupBy("_key").applyInPandasWithState(fire, "row string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return fired.select(F.from_json("row", requests.schema, JSON).alias("r")).select("r.*")
