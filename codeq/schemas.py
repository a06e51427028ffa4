"""Schemas of the canonical tables, for sources that carry none."""

from __future__ import annotations

from pyspark.sql import types as T

from codeq.operators.syntax import FINDING_FIELDS

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}

FILES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("review_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("content", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("file_id", T.LongType()),
    *[T.StructField(name, _KINDS[kind]) for name, kind in FINDING_FIELDS.items()],
])

REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("repository_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("total_lines", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ISSUES = T.StructType([
    T.StructField("issue_id", T.StringType()),
    T.StructField("review_id", T.LongType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("is_fixable", T.BooleanType()),
    T.StructField("is_acknowledged", T.BooleanType()),
])

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])
