"""Reading tables, and tables written in the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a session on one machine (master ``local[...]``) may fall back to a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spanlattice-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = "file://" + folder
    spark.sparkContext.setCheckpointDir(at)
    return at


#: Times that the bytes of a scratch table's files count in Spark's estimates.
UNPACKED = 1000.0


class Scratch:
    """Tables of one operator call, each written once and read back, so that a lost executor costs no recomputation.

    ``keep`` writes a table; ``drop`` removes one that no later plan reads. What is left when a result is returned may
    be read by it, so it stays until the caller has used the result and calls ``clear`` or empties the folder; operators take a
    Scratch of the caller, hold it as ``scratch`` or return a result with it (``handed``).

    Spark takes the size of a table's files for that of its rows, and broadcasts what seems small. Regular tables pack a hundredfold and more, so
    millions of rows went to the driver; here the files count UNPACKED times, and only sizes measured at an exchange make a join broadcast.

    The shuffle files of what makes a table go as soon as it is written, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        # the factor is a setting of the session that reads; this one is for reading scratch tables only
        self._reader = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        self._reader.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
        self._writer = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        self._writer.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        self._of(self._writer, df).write.parquet(path)
        out = self._of(self.spark, self._reader.read.schema(df.schema).parquet(path))
        out._scratch_path = path
        return out

    def _of(self, session: SparkSession, df: DataFrame) -> DataFrame:
        """The same, evaluated with the settings of ``session``."""
        made = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed())
        return DataFrame(made, session)

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def handed(self, df: DataFrame) -> DataFrame:
        """The result, with this as its ``scratch``: ``df.scratch.clear()`` when it is used."""
        df.scratch = self
        return df

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
