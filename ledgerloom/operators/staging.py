"""Results written once to the folder that the cluster shares, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with one of this application in it; a temporary one only where driver and
    executors are one process."""
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
        base = _own[app]
    return f"{base.rstrip('/')}/{app}"


def compilable(spark: SparkSession) -> None:
    """Stages whose generated method is too large for the JVM to compile run as expressions that are compiled one by one,
    from now on in the session: rows with a column for each measure would else be interpreted."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > 8000:
        spark.conf.set(name, 8000)


def staged_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    path = staged_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
