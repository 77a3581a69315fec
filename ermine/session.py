"""Session helpers: a SparkSession tuned for the engine, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every plan of the engine relies on.  The co-partition flag lets the
# pattern joins on (doc_id, sent_id, head = tok_id) reuse the (doc_id, sent_id)
# hash partitioning of the token table instead of shuffling each role again.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ermine",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's SQL settings to an existing session (idempotent)."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings on managed clusters
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read here.
    When it is unset on a local master (tests) a fresh scratch folder is created and set;
    elsewhere that would be a folder the executors cannot share, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        d = tempfile.mkdtemp(prefix="ermine-ckpt-", dir=os.environ.get("ERMINE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def compiled(spark):
    """Settings while a stage is stored.  Generated methods longer than the JVM compiles (8000 bytes) would be interpreted:
    Spark then takes its shorter ones.  Rows that are dealt out by bucket already are not sorted by it once more, and a task
    reads one bucket."""
    own = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.maxConcurrentOutputFileWriters": "4",
           "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


STORED = "zstd"  # of stages: a fifth less room for tokens than with the default


def cut_lineage(df):
    """Stage output as a Parquet table in the shared folder: no lineage, columns pruned, filters pushed down, and a lost
    executor recomputes nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    with compiled(spark):
        df.write.option("compression", STORED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage_by(df, key: str, pieces: int):
    """The same as a table of ``pieces`` buckets of ``key``, for a ``df`` dealt out that way: who groups or joins by
    ``key`` and more reads it without an exchange."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    with compiled(spark):
        (df.write.format("parquet").option("compression", STORED).bucketBy(pieces, key)
         .option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


PIECE_BYTES = 4 << 20


def text_pieces(df, column: str = "text", size: int = PIECE_BYTES) -> int:
    """Partitions for about ``size`` bytes of text each, however large the input."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size))
