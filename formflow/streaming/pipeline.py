"""The intake pipeline as streams: new mails in, tasks forward, results out.

Stages are linked by tables, not queue files; a query's checkpoint remembers
what it has seen, so a restart neither loses nor repeats a mail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formflow.functions import text as T
from formflow.operators import emails as E

# The stages in order.
STAGES = ("opencv", "layout", "ml")


def tasks(mails: DataFrame) -> DataFrame:
    """A pending task for every mail file."""
    return mails.select(
        T.task_id(F.col("path"), F.col("modification_time")).alias("task_id"), F.col("path").alias("eml_file"),
        F.col("modification_time").alias("created_at"), F.lit("pending").alias("status"), F.lit(STAGES[0]).alias("current_stage"),
    )


def progress(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Where every task stands: it advances while its stage has a result and is completed after the last.

    ``results``: ``task_id, stage, finished_at``; results of unknown tasks are
    ignored, repeated ones count once. A task waits at its first stage without
    a result, even if later ones have some.
    """
    stage_no = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    done = results.withColumn("_n", stage_no).filter("_n > 0").groupBy("task_id", "_n").agg(F.min("finished_at").alias("_at"))
    per_task = done.groupBy("task_id").agg(F.collect_set("_n").alias("_done"), F.max("_at").alias("_last"))
    n = len(STAGES)
    waiting = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(n + 1)), lambda k: ~F.array_contains("_done", k.cast("long"))), 1)
    joined = tasks.select("task_id", "eml_file", "created_at").join(per_task, "task_id", "left")
    joined = joined.withColumn("_wait", F.coalesce(F.when(F.col("_done").isNotNull(), waiting), F.lit(1)))
    names = F.array(*[F.lit(s) for s in STAGES])
    over = F.col("_wait") > n
    return joined.select(
        "task_id", "eml_file", "created_at",
        F.when(over, "completed").when(F.col("_done").isNull(), "pending").otherwise("processing").alias("status"),
        F.when(over, F.lit(STAGES[-1])).otherwise(F.try_element_at(names, F.col("_wait"))).alias("current_stage"),
        F.when(over, F.col("_last")).alias("completed_at"),
    )


def intake(mails: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the attachments of new mails to ``out`` as Parquet.

    ``once`` processes what is there and stops, else every five seconds.
    """
    parsed = E.parse_messages(mails)
    rows = E.attachment_rows(parsed).filter(E.is_pdf(F.col("content_type"), F.col("filename")))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def task_log(mails: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Tasks of new mails as Parquet, what is there now."""
    writer = tasks(mails).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def unprocessed(mails: DataFrame, seen: DataFrame) -> DataFrame:
    """Batch view: mails whose path has no task yet."""
    return mails.join(seen.select(F.col("eml_file").alias("path")), "path", "left_anti")


def stage_times(results: DataFrame) -> DataFrame:
    """Seconds between neighbouring stages of a task."""
    w = Window.partitionBy("task_id").orderBy("finished_at", "stage")
    gap = F.col("finished_at").cast("double") - F.lag(F.col("finished_at").cast("double")).over(w)
    return results.select("task_id", "stage", F.round(gap, 3).alias("seconds"))
