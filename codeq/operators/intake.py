"""From uploads to files: decoding, limits, duplicates, lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeq.functions.metrics import extension
from codeq.functions.sqltext import literal
from codeq.functions.text import split_lines
from codeq.rules.catalogue import ACCEPTED_EXTENSIONS, MAX_FILE_BYTES, MAX_FILES_PER_REVIEW


def read_uploads(spark: SparkSession, folder: str, pattern: str = "*",
                 limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below a folder (an absolute path or a URL): review_id, filename, upload_seq, n_bytes, bytes.

    The review is the first folder below, the filename the rest of the path; files that lie in the
    folder itself are those of review ".". Later changed files count as later uploads. ``bytes`` is
    null for files over the limit, which are not even read.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    root = re.sub(scheme, "", folder).rstrip("/")
    if not root.startswith("/"):
        raise ValueError(f"not an absolute folder: {folder}")
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", pattern).load(folder))
    below = F.expr(f"substring(regexp_replace(path, {literal(scheme)}, ''), {len(root) + 2})")
    slash = F.instr("below", "/")
    fits = F.col("length") <= limit
    parts = [raw.filter(fits).withColumn("bytes", F.col("content")),
             raw.filter(~fits).withColumn("bytes", F.lit(None).cast("binary"))]
    return parts[0].drop("content").unionByName(parts[1].drop("content")).withColumn("below", below).select(
        F.when(slash > 0, F.substring_index("below", "/", 1)).otherwise(".").alias("review_id"),
        F.expr("substring(below, instr(below, '/') + 1)").alias("filename"),
        F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("upload_seq"),
        F.col("length").alias("n_bytes"), "bytes")


def decode(uploads: DataFrame) -> DataFrame:
    """Adds ``is_rejected`` for bytes that are not UTF-8 and ``content`` for those that are."""
    text = F.col("bytes").cast("string")
    return uploads.withColumn("is_rejected", ~F.is_valid_utf8(text)).withColumn(
        "content", F.when(~F.col("is_rejected"), text))


def check_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds n_bytes and ``is_oversize``."""
    return files.withColumn("n_bytes", F.octet_length("content").cast("long")).withColumn(
        "is_oversize", F.col("n_bytes") > limit)


def check_uploads(uploads: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Uploads (review_id, filename, upload_seq, bytes) decoded and flagged.

    The size is ``n_bytes`` where the uploads have it, so bytes need not be read for it; what is too
    large is not decoded and not called broken text.
    """
    size = F.col("n_bytes") if "n_bytes" in uploads.columns else F.octet_length("bytes")
    judged = uploads.withColumn("is_oversize", size > limit)
    small = judged.withColumn("bytes", F.when(~F.col("is_oversize"), F.col("bytes")))
    return decode(small).withColumn("is_rejected", F.coalesce("is_rejected", F.lit(False))).drop(
        "bytes", "n_bytes")


def rejected_reviews(checked: DataFrame, limit: int = MAX_FILES_PER_REVIEW) -> DataFrame:
    """Reviews with too many uploads or any upload that is too large or not text."""
    judged = checked.groupBy("review_id").agg(
        F.count("*").alias("n_uploads"), F.count_if("is_oversize").alias("n_oversize"),
        F.count_if("is_rejected").alias("n_not_text"))
    return judged.filter((F.col("n_uploads") > limit) | (F.col("n_oversize") > 0)
                         | (F.col("n_not_text") > 0))


def file_id() -> Column:
    """The number of a file: the same for the same review and filename, whoever asks."""
    return F.xxhash64("review_id", "filename")


def accepted_files(checked: DataFrame, rejected: DataFrame) -> DataFrame:
    """Files of the accepted reviews, the last upload of each name, numbered."""
    kept = checked.select("review_id", "filename", "upload_seq", "content").join(
        rejected.select("review_id"), "review_id", "left_anti")
    return last_upload(kept).select(file_id().alias("file_id"), "review_id", "filename", "content")


def check_file_count(files: DataFrame, limit: int = MAX_FILES_PER_REVIEW) -> DataFrame:
    """Files per review, and whether a review is turned away for having too many."""
    counted = files.groupBy("review_id").agg(F.count("*").alias("n_files"))
    return counted.withColumn("is_rejected", F.col("n_files") > limit)


def within_file_count(files: DataFrame, limit: int = MAX_FILES_PER_REVIEW) -> DataFrame:
    """Files of the reviews within the limit."""
    kept = check_file_count(files, limit).filter(~F.col("is_rejected"))
    return files.join(kept, "review_id", "left_semi")


def accepted(files: DataFrame) -> DataFrame:
    return files.filter(extension(F.col("filename")).isin(*ACCEPTED_EXTENSIONS))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "file_id", F.posexplode(split_lines(F.col("content"))).alias("i", "line")
    ).select("file_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def last_upload(uploads: DataFrame) -> DataFrame:
    """The last upload of each filename in a review.

    The last number is found on narrow rows, and only then do the uploads meet it. Of uploads with
    the same number the one with the greatest hash of its columns stays.
    """
    keys = ["review_id", "filename"]
    rest = [c for c in uploads.columns if c not in keys]
    tied = uploads.withColumn("_tie", F.xxhash64(*rest))
    narrow = tied.select(*keys, "upload_seq", "_tie")
    newest = narrow.groupBy(*keys).agg(F.max("upload_seq").alias("upload_seq"))
    chosen = narrow.join(newest, [*keys, "upload_seq"]).groupBy(*keys, "upload_seq").agg(
        F.max("_tie").alias("_tie"))
    return tied.join(chosen, [*keys, "upload_seq", "_tie"], "left_semi").select(*keys, *rest)


def first_uploads(uploads: DataFrame, limit: int = MAX_FILES_PER_REVIEW) -> DataFrame:
    """The first upload of each filename, and of those the first 20 of a review."""
    firsts = uploads.groupBy("review_id", "filename").agg(F.min("upload_seq").alias("upload_seq"))
    order = Window.partitionBy("review_id").orderBy("upload_seq", "filename")
    return (firsts.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= limit).drop("place"))
