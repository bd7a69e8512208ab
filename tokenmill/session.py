"""Session settings shared by the entry point, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tokenmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Open a session. On a cluster master and sizing come from spark-submit, so both are optional."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or where it is unset one below the warehouse, on any master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tokenmill-scratch"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize `df` in the shared folder so that iterations do not replay their history."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
