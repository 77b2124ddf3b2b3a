"""Streaming forms: the same aggregates over unbounded packets, with watermarks and bounded state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(packets: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A timestamp beside the nanoseconds, and how late packets may come."""
    return packets.withColumn("ts", F.timestamp_micros((F.col("ts_nano") / 1000).cast("long"))).withWatermark("ts", late)


def timeline(packets: DataFrame, seconds: int = 5, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows."""
    p = F.col("ip_proto")
    w = with_time(packets, late).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_if(p == 6).alias("tcp"), F.count_if(p == 17).alias("udp"))
    return w.select(F.unix_seconds("w.start").alias("bucket"), "packets", "bytes", "tcp", "udp")


def sliding(packets: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Windows aligned to the epoch: an unbounded stream has no first packet to begin from."""
    w = with_time(packets, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return w.select(F.unix_seconds("w.start").alias("window_start"), "packets", "bytes")


def sessions(packets: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    s = with_time(packets, late).groupBy("flow_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return s.select("flow_id", F.unix_micros("w.start").alias("start_micros"), "packets", "bytes")


def deduplicated(packets: DataFrame, late: str = "10 minutes", key: str = "packet_id") -> DataFrame:
    return with_time(packets, late).dropDuplicatesWithinWatermark([key])


def flow_gate(packets: DataFrame, least: int = 10, idle_ms: int = 300_000) -> DataFrame:
    """Flow samples from packet least + 1 on, with the flow's count and bytes so far; state goes when a flow is idle."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0)
        for pdf in frames:
            pdf = pdf.sort_values("packet_id", kind="stable")
            counts = n + 1 + pd.Series(range(len(pdf)), index=pdf.index)
            sizes = total + pdf["length"].cumsum()
            n, total = n + len(pdf), int(sizes.iloc[-1]) if len(pdf) else total
            out = pd.DataFrame({"flow_id": key[0], "packet_id": pdf["packet_id"], "packets": counts, "bytes": sizes})
            yield out[out.packets > least]
        state.update((n, total))
        state.setTimeoutDuration(idle_ms)

    return packets.select("flow_id", "packet_id", "length").groupBy("flow_id").applyInPandasWithState(
        run, "flow_id string, packet_id long, packets long, bytes long", "n long, total long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def moving_average(samples: DataFrame, key: str, value: str, alpha: float = 0.1, least: int = 10, limit: float = 3.0) -> DataFrame:
    """Exponential mean and variance kept for each key; a value is odd against what came before it."""

    def run(k, frames, state: GroupState):
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            rows = []
            for x in pdf.sort_values("packet_id", kind="stable").itertuples():
                v = float(getattr(x, value))
                odd = bool(n >= least and var > 0 and abs(v - mean) / var**0.5 > limit)
                if n == 0:
                    mean = v
                else:
                    delta = v - mean
                    mean, var = mean + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
                n += 1
                rows.append((k[0], x.packet_id, mean, odd))
            yield pd.DataFrame(rows, columns=[key, "packet_id", "ema", "is_anomaly"])
        state.update((n, mean, var))

    kind = dict(samples.dtypes)[key]
    return samples.select(key, "packet_id", value).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, packet_id long, ema double, is_anomaly boolean", "n long, mean double, var double", "append", GroupStateTimeout.NoTimeout
    )


def to_batches(stream: DataFrame, write, checkpoint: str, seconds: int | None = None):
    """Each micro-batch goes to write(frame, number); replayed batches have the same number."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
