"""Attempts at tasks as a ledger: bounded retries with growing waits, where each round runs only what is due.

folder/ledger/round=N has a row (task_id, hash, attempt, state, error, next_at) for each task that round N tried, and
folder/commits the numbers of the complete rounds. A task's last row tells its state: done, waiting for next_at, or failed
when its retries are used up. A task whose hash has changed starts anew. A round that is lost before its end is run again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders

#: Retries after the first attempt, and the seconds of the first wait; the n-th is n times as long.
RETRIES, WAIT = 2, 0.6
SCHEMA = "task_id string, hash string, attempt int, state string, error string, next_at double, round int"

Work = Callable[[DataFrame], DataFrame]


def _rounds(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in folders.names(spark, f"{folder}/commits") if n.isdigit())


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts."""
    done = [f"{folder}/ledger/round={n}" for n in _rounds(spark, folder)]
    return spark.read.schema(SCHEMA).option("basePath", f"{folder}/ledger").parquet(*done) if done else spark.createDataFrame([], SCHEMA)


def standing(spark: SparkSession, folder: str) -> DataFrame:
    """Each task's last attempt."""
    rest = [c.split()[0] for c in SCHEMA.split(", ")[1:]]
    return ledger(spark, folder).groupBy("task_id").agg(F.max_by(F.struct(*rest), "round").alias("r")).select("task_id", "r.*")


def due(tasks: DataFrame, last: DataFrame, now: float, again: bool = False) -> DataFrame:
    """The tasks(task_id, hash, …) to be tried now, with their attempt's number, from 1; again: failed ones, too, anew."""
    last = last.select("task_id", F.col("hash").alias("_hash"), F.col("attempt").alias("_attempt"), F.col("state").alias("_state"), "next_at")
    new = F.col("_state").isNull() | ~F.col("hash").eqNullSafe(F.col("_hash"))
    anew = new | (F.lit(again) & (F.col("_state") == "failed"))
    ready = anew | ((F.col("_state") == "waiting") & (F.col("next_at") <= now))
    attempt = F.when(anew, 1).otherwise(F.col("_attempt") + 1).alias("attempt")
    return tasks.join(last, "task_id", "left").where(ready).select(*tasks.columns, attempt)


def run_round(folder: str, tasks: DataFrame, work: Work, now: float, retries: int = RETRIES, wait: float = WAIT, again: bool = False) -> int:
    """Tries the tasks that are due and gives their number.

    work: from the due tasks, with attempt, to (task_id, error) with one row of each, error null where it went well; a
    task without a row has failed, and all have if the job fails as a whole. Task ids are distinct texts.
    """
    spark = tasks.sparkSession
    n = max(_rounds(spark, folder), default=0) + 1
    # What is due is written first, so that lost executors can't change it.
    at = f"{folder}/due/round={n}"
    due(tasks, standing(spark, folder), now, again).write.mode("overwrite").parquet(at)
    now_due = spark.read.parquet(at)
    tried = now_due.count()

    def note(error: DataFrame) -> None:
        state = F.when(F.col("error").isNull(), "done").when(F.col("attempt") <= retries, "waiting").otherwise("failed")
        rows = error.select("task_id", "hash", "attempt", state.alias("state"), "error", F.when(state == "waiting", now + wait * F.col("attempt")).cast("double").alias("next_at"))
        rows.write.mode("overwrite").parquet(f"{folder}/ledger/round={n}")

    if tried:
        own = now_due.select("task_id", "hash", "attempt")
        try:
            answers = work(now_due).groupBy("task_id").agg(F.max("error").alias("_error"), F.lit(True).alias("_there"))
            note(own.join(answers, "task_id", "left").withColumn("error", F.when(F.col("_there"), F.col("_error")).otherwise("no answer")))
        except Exception as e:  # noqa: BLE001
            note(own.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:1000])))
        folders.mark(spark, f"{folder}/commits/{n}")
    folders.delete(spark, at)
    return tried


def run(folder: str, tasks: DataFrame, work: Work, retries: int = RETRIES, wait: float = WAIT, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rounds until no task waits; gives each task's last attempt. Failed tasks of an earlier call are tried anew, done ones are not."""
    spark = tasks.sparkSession
    again = True
    while True:
        run_round(folder, tasks, work, clock(), retries, wait, again)
        again = False
        mine = standing(spark, folder).join(tasks.select("task_id", "hash"), ["task_id", "hash"], "left_semi")
        next_at = mine.where("state = 'waiting'").agg(F.min("next_at")).first()[0]
        if next_at is None:
            return mine
        sleep(max(0.0, next_at - clock()))
