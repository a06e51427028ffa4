"""The canonical tables, as views over the given Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeq.functions.sqltext import array, literal, struct
from codeq.rules.catalogue import PATTERN_RULES
from codeq.sources.snippets import SNIPPETS


def table(spark: SparkSession, folder: str, name: str, stream: bool = False) -> DataFrame:
    """A given table, whole or as a stream of its files."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not stream:
        return df
    # A glob, because a file stream takes no path of a single file.
    return spark.readStream.schema(df.schema).parquet(f"{folder}/{name}.parque[t]")


SHARE_ROWS = 256  # a share of a row group has about so many rows or more
MOST_SHARES = 32  # and a row group is read so many times at most
TASK_ROWS = 8192  # more rows than this are shared out whatever the cores, so no task's time grows with the table


def dealt(df: DataFrame) -> DataFrame:
    """The same rows of a table of few or large row groups, dealt to all cores without a shuffle.

    One task reads a row group, so long work on a small table would leave most cores idle, and on a table
    of large ones be long itself. Here several tasks read it, and each keeps the rows of its share, by their
    number in the file, before anything is made of them. ``df`` is a table as read; with a file per core or
    more, none of many rows, it stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id()).count().agg(F.count("*").alias("tasks"), F.max("count").alias("rows")).first()
    if not held["tasks"]:
        return df
    wanted = max(-(-cores // held["tasks"]), -(-held["rows"] // TASK_ROWS))
    shares = min(wanted, held["rows"] // SHARE_ROWS, MOST_SHARES)
    if shares < 2:
        return df
    # By a hash, as long rows may come at regular places.
    share = F.pmod(F.xxhash64("_metadata.row_index"), F.lit(shares))
    parts = [df.filter(share == i) for i in range(shares)]
    # Coalescing to more tasks than there are does nothing, but keeps the work above from being planned once per share.
    return reduce(DataFrame.union, parts).coalesce(1 << 30)


def _pick(values: list, index: Column) -> Column:
    """The value at a 0-based index of a constant list; folded into the plan, so no join."""
    return F.get(F.expr(array(values)), index)


def files(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Source files: the prose of a document, as comments in Python files, then a snippet."""
    k = (F.col("doc_id") % len(SNIPPETS)).cast("int")
    ext = _pick([e for e, _ in SNIPPETS], k)
    commented = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    prose = F.when(ext == "py", commented).otherwise(F.col("text"))
    documents = table(spark, folder, "documents", stream)
    documents = (documents if stream else dealt(documents)).select("doc_id", "source", "text")
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("review_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        F.concat(prose, F.lit("\n"), _pick([c for _, c in SNIPPETS], k)).alias("content"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), F.floor("c_acctbal").cast("string"),
                 F.lit("@example.com")).alias("email"),
        F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("full_name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


STATUS_CODES = {"F": "complete", "O": "analyzing", "P": "failed"}


def reviews(spark: SparkSession, folder: str, stream: bool = False,
            status: str | None = None) -> DataFrame:
    """Reviews, all or of one status; asking for the status here lets the scan skip the others."""
    price = F.floor("o_totalprice")
    orders = table(spark, folder, "orders", stream)
    if status is not None:
        orders = orders.filter(F.col("o_orderstatus").isin(
            *[code for code, name in STATUS_CODES.items() if name == status]))
    return orders.select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("author_id"),
        F.when(F.col("o_orderpriority") != "5-LOW",
               F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("repository_id"),
        F.concat(F.lit("Review "), F.col("o_orderkey").cast("string"), F.lit(" with priority "),
                 F.col("o_orderpriority")).alias("title"),
        F.expr("case o_orderstatus " + " ".join(
            f"when '{code}' then '{name}'" for code, name in STATUS_CODES.items()) + " end")
        .alias("status"),
        ((price % 201) / 2.0).alias("quality_score"),
        (price % 1000).alias("total_lines"),
        F.col("o_orderdate").alias("created_at"),
    )


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """One issue per order line; the part number picks the rule."""
    rules = ", ".join(struct(
        rule_id=literal(r.rule_id), category=literal(r.category), severity=literal(r.severity),
        title=literal(r.title), is_fixable=literal(r.fixable)) for r in PATTERN_RULES)
    rule = F.get(F.expr(f"array({rules})"), (F.col("l_partkey") % len(PATTERN_RULES)).cast("int"))
    return table(spark, folder, "lineitem").select(
        F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
              .cast("binary")).alias("issue_id"),
        F.col("l_orderkey").alias("review_id"),
        F.col("l_linenumber").cast("long").alias("file_no"),
        rule.alias("rule"),
        F.nullif(F.col("l_quantity").cast("int"), F.lit(50)).alias("line_start"),
        (F.col("l_returnflag") == "R").alias("is_acknowledged"),
    ).select("issue_id", "review_id", "file_no", "rule.*", "line_start", "is_acknowledged")


def review_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of reviews, numbered up to six; issues may name a seventh, which is not there."""
    return issues(spark, folder).filter("file_no <= 6").select("review_id", "file_no").distinct().withColumn(
        "file_key", file_key())


def file_key() -> Column:
    return F.concat_ws("/", "review_id", "file_no")


def issue_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """A suggestion for each issue that can be fixed."""
    return issues(spark, folder).filter("is_fixable").select("issue_id")


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories named by any review, last updated by the newest one."""
    return (
        reviews(spark, folder).filter(F.col("repository_id").isNotNull())
        .groupBy("repository_id")
        .agg(F.min("author_id").alias("owner_id"), F.max("created_at").alias("updated_at"))
        .withColumn("name", F.concat(F.lit("repo-"), F.col("repository_id").cast("string")))
    )


def toggles(spark: SparkSession, folder: str) -> DataFrame:
    """Acknowledge clicks: one per order line, several for the same (review, issue number)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").cast("long").alias("issue_no"))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The acknowledge clicks with their times."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").cast("long").alias("issue_no"),
        F.col("l_shipdate").alias("at"))


def begun_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """What the status events of a review are made of: its day and its code."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("review_id"), "o_orderdate", "o_orderstatus")


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return status_steps(begun_reviews(spark, folder))


def status_steps(begun: DataFrame) -> DataFrame:
    """A review goes pending, analyzing a day later, and to its end a week after that."""
    end = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete")
    steps = F.array(*[
        F.struct(status.alias("status"), F.date_add(F.to_date("o_orderdate"), days).alias("day"))
        for status, days in ((F.lit("pending"), 0), (F.lit("analyzing"), 1), (end, 8))])
    return begun.select("review_id", F.explode(steps).alias("e")).select("review_id", "e.*")


def activity(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    return table(spark, folder, "events", stream).select(
        "event_id", "user_id", "ts", "event_type", "value")
