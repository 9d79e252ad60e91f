"""Structured Streaming counterparts of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bars(stream: DataFrame, watermark: str = "3 days", days: int = 7, start: str = "2 days") -> DataFrame:
    """Bars of (entity, ts, price, volume) over Saturday-to-Friday weeks, given out once the watermark closes them."""
    w = F.window("ts", f"{days} days", f"{days} days", start)
    return stream.withWatermark("ts", watermark).groupBy("entity", w.alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")).select("entity", F.to_date(F.date_sub(F.to_date("w.end"), 1)).alias("week"), "open", "high", "low", "close", "volume")


def append_unique(stream: DataFrame, key: str, ts: str, watermark: str = "30 days") -> DataFrame:
    """Without exact repeats of a key inside the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def conflicts(stored: DataFrame, batch: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Rows of a batch whose key is stored with another payload; used inside foreachBatch."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*payload)), 256).alias("digest"))
    both = digest(batch).join(digest(stored).withColumnRenamed("digest", "held"), key)
    return batch.join(both.where("digest <> held").select(key), key, "left_semi")


def sessionize(stream: DataFrame, gap: str, watermark: str = "1 day") -> DataFrame:
    """Episodes of an entity's events (entity, ts): gaps up to `gap` keep one open."""
    return stream.withWatermark("ts", watermark).groupBy("entity", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def gate(good: F.Column) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """Splits a batch by a rule that must hold (null fails): (good rows, quarantine)."""
    ok = F.coalesce(good, F.lit(False))
    return lambda batch: (batch.where(ok), batch.where(~ok))


def confirm_labels(stream: DataFrame, confirm: int = 2, cooldown: int = 4, watermark: str = "30 days", idle_days: int = 400) -> DataFrame:
    """(entity, ts, id, label) as stabilised labels, by the kernel of the batch job. State per entity is what the kernel goes
    on from; it is dropped after idle_days of event time without a row."""
    import pandas as pd

    from ..operators.labels import stabilise

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        label, _, after = stabilise(rows["label"].tolist(), confirm, cooldown, state.get if state.exists else None)
        state.update(after)
        last = int(rows["ts"].max().timestamp() * 1000) + idle_days * 86_400_000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(confirmed=label)[["entity", "ts", "id", "confirmed"]]

    keyed = stream.withWatermark("ts", watermark).groupBy("entity")
    return keyed.applyInPandasWithState(step, "entity string, ts timestamp, id long, confirmed string", "rows long, before string, run long, way long, at long", "append", "EventTimeTimeout")


def mature(waiting: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The outcomes of waiting (id, entity, date, horizon) whose sessions have passed, by the batch job's rules."""
    from ..operators.outcomes import replay_outcomes

    first = waiting.agg(F.min("date").alias("_from"))  # bars before the oldest waiting observation play no part
    recent = bars.join(F.broadcast(first), F.col("date") >= F.col("_from")).drop("_from").join(waiting.select("entity").distinct(), "entity", "left_semi")
    done = replay_outcomes(waiting.select("id", "entity", "date").distinct(), recent, horizons)
    return done.join(waiting.select("id", "horizon"), ["id", "horizon"], "left_semi")


def mature_stream(observations: DataFrame, bars: Callable[[], DataFrame], path: str, horizons: tuple[int, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for observations with ids that don't repeat (dropDuplicates keeps them so): appends the outcomes
    that have matured by the bars of now, and hands on those that still wait, by horizon.

    A batch reads its own rows and the waiting ones, never those that have left. It writes its own folders, and again if
    it runs again, so outcomes stay unique and never change.
    """
    spark = observations.sparkSession
    kind = observations.schema["id"].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "entity", "date", F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon"))
        if number:
            rows = spark.read.schema(f"id {kind}, entity string, date date, horizon int").parquet(f"{path}/waiting/batch={number - 1}").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{path}/asked/batch={number}")
        waiting = spark.read.schema(rows.schema).parquet(f"{path}/asked/batch={number}")
        out = f"{path}/outcomes/batch={number}"
        mature(waiting, bars(), horizons).select("id", "entity", "date", "horizon", "entry", "ret", "mfe", "mae").write.mode("overwrite").parquet(out)
        left = waiting.join(spark.read.parquet(out).select("id", "horizon"), ["id", "horizon"], "left_anti")
        left.select("id", "entity", "date", "horizon").write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")

    return step


def gate_stream(good: F.Column, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes good rows and quarantined ones to two tables, a folder for each batch."""
    split = gate(good)

    def step(batch: DataFrame, number: int) -> None:
        for name, rows in zip(("good", "quarantine"), split(batch)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return step


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed all that a stream has now to a foreachBatch sink."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Write all that a stream has now to Parquet, then read it: how the queries and tests drive streams."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
