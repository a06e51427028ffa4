"""The whole way of a set of uploads: checked, analysed, written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.operators import intake
from codeq.operators.findings import all_findings
from codeq.operators.metrics import file_metrics, review_figures
from codeq.rules.catalogue import PATTERN_RULES, PatternRule
from codeq.session import shared_folder
from codeq.sources.sinks import read_back, write_findings, write_table


@dataclass(frozen=True)
class Tables:
    """Where the results of an analysis were written."""

    files: str
    rejected: str
    findings: str
    file_metrics: str
    review_metrics: str


def analyse(uploads: DataFrame, folder: str | None = None,
            rules: Sequence[PatternRule] = PATTERN_RULES) -> Tables:
    """Analyse uploads (review_id, filename, upload_seq, bytes) and write all results.

    ``rules`` are the pattern rules; a pack of one's own goes into findings, counts and scores.

    A review is turned away as a whole when it has too many files, or one that is too large or is
    not text. The accepted files are written first; all that follows reads them from there.
    """
    spark = uploads.sparkSession
    folder = folder or shared_folder(spark, "analysis")
    checked = intake.check_uploads(uploads)
    rejected = write_table(intake.rejected_reviews(checked), f"{folder}/rejected")
    accepted = intake.accepted_files(checked, read_back(spark, rejected))
    files_path = write_table(accepted, f"{folder}/files")
    files = read_back(spark, files_path)
    findings = write_findings(all_findings(files, rules), f"{folder}/findings")
    metrics = write_table(file_metrics(files, rules, hashes=True), f"{folder}/file_metrics")
    reviews = review_figures(read_back(spark, metrics)).withColumn(
        "status", F.when(F.col("n_failed") > 0, "failed").otherwise("complete")).drop("n_failed")
    return Tables(files_path, rejected, findings, metrics,
                  write_table(reviews, f"{folder}/review_metrics"))
