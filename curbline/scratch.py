"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that removes a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.curbline.scratch", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="curbline-")
            spark.conf.set("spark.curbline.scratch", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    try:
        spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return _written(df, name)[0]


class Scope:
    """Scratch tables of one operator: ``with Scope(spark) as scratch``. What ``settle`` writes goes when the scope ends, or
    earlier by ``drop``; what ``give`` writes stays, for the result reads it. Tables of rounds thus take no more disk than the rounds that are alive."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.alive = spark, {}

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[df for df, _ in self.alive.values()])

    def settle(self, df: DataFrame, name: str = "step") -> DataFrame:
        got, path = _written(df, name)
        self.alive[id(got)] = (got, path)
        return got

    def give(self, df: DataFrame, name: str = "result") -> DataFrame:
        return settle(df, name)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.alive.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_settled(*dfs: DataFrame) -> None:
    """Delete tables written by :func:`settle` once nothing reads them any more."""
    for df in dfs:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            delete(df.sparkSession, path)
