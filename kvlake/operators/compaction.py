"""Merging sorted runs, and the policy that picks what to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.model import PUT
from kvlake.operators.mvcc import newest
from kvlake.options import Options


def flush(log: DataFrame) -> DataFrame:
    """The newest version of each key in each ``run``; tombstones stay."""
    return newest(log, by=("run", "key"))


def run_bounds(runs: DataFrame) -> DataFrame:
    """Smallest and largest key, rows and sequences of each run."""
    return runs.groupBy("run").agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count("*").alias("n_entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def merge(runs: DataFrame, priority: str = "prio") -> DataFrame:
    """All rows by key; of equal keys those of the newer run (lower priority) first."""
    return runs.orderBy("key", priority)


def compact(runs: DataFrame, priority: str = "prio", drop_tombstones: bool = False) -> DataFrame:
    """The row of the newest run for each key; at the bottom, deletes go."""
    w = Window.partitionBy("key").orderBy(priority)
    kept = runs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return kept.where(F.col("op") == PUT) if drop_tombstones else kept


def target_size(level: Column, options: Options = Options()) -> Column:
    """Target bytes of a level; null for level 0, which files bound."""
    grown = F.pow(F.lit(float(options.level_size_multiplier)), (level - 1).cast("double"))
    return F.when(level > 0, (F.lit(float(options.base_level_size)) * grown).cast("long"))


def level_sizes(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Files, bytes and target of each level."""
    sums = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"))
    return sums.withColumn("target_size", target_size(F.col("level"), options))


def pick(files: DataFrame, options: Options = Options()) -> DataFrame:
    """The files to compact: level, output level and inputs; no row if none is due.

    Level 0 first, once it has enough files, all of them.  Then the lowest
    level over its target, except the last, with its lowest-numbered file.
    Files of the output level that overlap the inputs belong to the job
    (``overlapping``), which keeps an output level free of overlaps.
    """
    sums = level_sizes(files, options)
    due = ((F.col("level") == 0) & (F.col("n_files") >= options.level0_compaction_threshold)) | (
        F.col("level").between(1, options.max_levels - 2) & (F.col("total_size") > F.col("target_size"))
    )
    level = sums.where(due).agg(F.min("level").alias("level")).where("level is not null")
    inputs = files.join(level, "level")
    rank = F.row_number().over(Window.partitionBy("level").orderBy("file_number"))
    inputs = inputs.withColumn("_rank", rank).where("level = 0 or _rank = 1").drop("_rank")
    return inputs.withColumn("output_level", F.col("level") + 1)


def overlapping(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """Files of the output level whose keys overlap the range of the inputs."""
    span = inputs.groupBy(F.col("output_level").alias("_out")).agg(F.min("smallest_key").alias("_lo"), F.max("largest_key").alias("_hi"))
    return files.join(span, (F.col("level") == F.col("_out")) & (F.col("smallest_key") <= F.col("_hi")) & (F.col("largest_key") >= F.col("_lo")), "left_semi")


def replay(edits: DataFrame) -> DataFrame:
    """Live files after a list of AddFile and DeleteFile edits, in ``edit_pos`` order.

    A file is live if the last edit of its (level, number) adds it.
    """
    files = edits.where(F.col("kind").isin("AddFile", "DeleteFile"))
    w = Window.partitionBy("level", "file_number").orderBy(F.col("edit_pos").desc())
    last = files.withColumn("_rank", F.row_number().over(w)).where("_rank = 1 and kind = 'AddFile'")
    return last.drop("_rank", "kind", "edit_pos")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size"))
