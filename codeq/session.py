"""Sessions for tests and benchmarks, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "codeq") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``.

    Where that is unset it lies below the warehouse; on a cluster that must not be a local folder, which
    executors would not share, and is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        is_local = base.startswith(("file:", "/")) or ":" not in base
        if is_local and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"name a folder that all executors share in spark.checkpoint.dir; {base} is not")
    return f"{base.rstrip('/')}/codeq/{purpose}-{uuid.uuid4().hex}"
