"""Repeated blocks of lines: runs of consecutive code lines that an earlier file has as well.

Each run of ``min_lines`` lines is traced to the first place that has it, by file and then by line.
Neighbouring runs that are traced to neighbouring places are one block. A place is traced to one other,
so there are never more links than lines, however often a run occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeq.functions.text import split_lines, strip
from codeq.operators.duplication import MIN_CHARS, line_hash

MIN_LINES = 6
HOT_SHARE = 1000  # a run is hot with a thousandth of all places: a thousand runs at most


def line_runs(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per run of ``min_lines`` code lines: file_id, place (from 0), the lines it spans, its hash.

    Lines count as for duplication: stripped, more than 10 characters, no ``#`` comments. What lies
    between two of them does not part them.
    """
    lines = F.transform(split_lines(F.col("content")), lambda x, i: F.struct(
        (i + 1).alias("no"), strip(x).alias("line")))
    code = F.filter(lines, lambda x: (F.length(x.line) > MIN_CHARS) & ~F.startswith(x.line, F.lit("#")))
    kept = files.select("file_id", F.transform(code, lambda x: F.struct(
        x.no.alias("no"), line_hash(x.line).alias("h"))).alias("kept"))
    hashes = kept.select("file_id", F.transform("kept", lambda x: x.no).alias("no"),
                         F.transform("kept", lambda x: F.hex(x.h)).alias("h"))
    places = F.when(F.size("h") >= min_lines, F.sequence(F.lit(0), F.size("h") - min_lines))
    return hashes.select("file_id", "no", F.explode(F.transform(places, lambda i: F.struct(
        i.alias("place"), F.unhex(F.md5(F.concat_ws("", F.slice("h", i + 1, min_lines)).cast("binary")))
        .alias("h")))).alias("run")).select(
        "file_id", "run.place", F.get("no", F.col("run.place")).alias("first_line"),
        F.get("no", F.col("run.place") + (min_lines - 1)).alias("last_line"), "run.h")


def traced(runs: DataFrame) -> DataFrame:
    """The runs that have an earlier place, with it: origin_file_id, origin_place, origin_line.

    First places are found by an aggregation that combines in each task. Those of hot runs, at most
    ``HOT_SHARE`` of them, are broadcast, and their places go through the join under keys of their own;
    any other run has less than a thousandth of all places.
    """
    firsts = runs.groupBy("h").agg(
        F.count("*").alias("n"), F.min(F.struct("file_id", "place", "first_line")).alias("origin"))
    hot_from = firsts.agg(F.sum("n") / HOT_SHARE).scalar()
    repeated = firsts.filter("n > 1")
    hot = repeated.filter(F.col("n") >= hot_from).select("h", F.col("origin").alias("hot"))
    cold = repeated.filter(F.col("n") < hot_from).select(F.col("h").alias("key"), F.col("origin").alias("cold"))
    apart = F.unhex(F.md5(F.concat_ws("/", F.hex("h"), "file_id", "place").cast("binary")))
    keyed = runs.join(F.broadcast(hot), "h", "left").withColumn(
        "key", F.when(F.col("hot").isNull(), F.col("h")).otherwise(apart))
    found = keyed.join(cold, "key", "left").withColumn("origin", F.coalesce("hot", "cold"))
    elsewhere = (F.col("origin.file_id") != F.col("file_id")) | (F.col("origin.place") != F.col("place"))
    return found.filter(elsewhere).select(
        "file_id", "place", "first_line", "last_line", F.col("origin.file_id").alias("origin_file_id"),
        F.col("origin.place").alias("origin_place"), F.col("origin.first_line").alias("origin_line"))


def duplicate_blocks(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal blocks of code lines that have an earlier place: file_id, first_line, last_line, n_lines,
    origin_file_id, origin_line.

    A block's runs have their first places in one file, one after the other; where these move to another
    file a new block begins, so blocks may share lines. A file may repeat itself. Files are of bounded
    size, so the runs of one file share a task. Null content has no lines.
    """
    links = traced(line_runs(files, min_lines)).withColumn("ahead", F.col("place") - F.col("origin_place"))
    pair = ["file_id", "origin_file_id", "ahead"]
    turn = F.row_number().over(Window.partitionBy(*pair).orderBy("place"))
    return links.withColumn("island", F.col("place") - turn).groupBy(*pair, "island").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"),
        (F.count("*") + (min_lines - 1)).alias("n_lines"), F.min("origin_line").alias("origin_line"),
    ).select("file_id", "first_line", "last_line", "n_lines", "origin_file_id", "origin_line")
