"""Tables written once into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only on one machine (local[..], as in tests) a temporary folder may stand in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder, shared by driver and executors, that tables used twice are written to")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='flowloom-')}"
    return _own[context.applicationId]


def private_dir(spark: SparkSession, kind: str) -> str:
    """A new name for a folder of this application, which goes when the driver ends: results that read it are lazy, so it has to last until then."""
    top = f"{shared_dir(spark)}/flowloom-tables/{spark.sparkContext.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(_delete, spark, top)
    return f"{top}/{kind}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder can be deleted by its application's id
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet under spark.checkpoint.dir, read again: parts that several plans use are computed once and survive lost executors."""
    spark = df.sparkSession
    path = private_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """stored() with the rows dealt by keys into as many buckets as a shuffle has partitions: tables of the same keys are joined or grouped by them without an exchange.

    One exchange before the write gives a bucket one file. Buckets are known to the session's catalog, by a name that goes when the driver ends, as the folder does.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), private_dir(spark, "bucketed")
    name = f"flowloom_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
