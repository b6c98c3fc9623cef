"""Session factory and the helpers that place intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def build_session(app: str = "cuebound", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; on a cluster the submit settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and the session is local; a cluster
    without that setting is an error, since a folder of one machine would not be shared."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(configured)
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="cuebound-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    context.setCheckpointDir(_LOCAL[0])
    return _LOCAL[0]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cuebound-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at path."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Remove what is at path, if anything is."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def clean_shared(spark: SparkSession) -> None:
    """Remove the tables that this application wrote into the shared folder; results that still read them end with that."""
    delete(spark, _app_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: a cut that is columnar and compressed."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, *columns: str) -> DataFrame:
    """Write df once into the shared folder in n hash buckets by columns, and read it back: joins on these columns do not shuffle it."""
    spark, label = df.sparkSession, f"cuebound_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, *columns).write.format("parquet").option("compression", "zstd").option("path", shared_path(spark, name))
    writer.bucketBy(n, *columns).saveAsTable(label)
    found = spark.table(label)
    found.schema  # noqa: B018 - resolved before its name goes
    spark.sql(f"DROP TABLE {label}")  # the name only; the files stay where they are
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when it is read in fewer partitions than there are (one small file, say); larger inputs stay as they are,
    without a shuffle. For work that costs much per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
