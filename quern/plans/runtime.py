"""Session helpers: where tables are read, and where intermediate results are cut off from their lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session, where they could not import it: when it is neither installed nor in PYTHONPATH."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(sc, "_quern_shipped", False) or str(root) in paths or "site-packages" in root.parts:
        return
    with tempfile.NamedTemporaryFile(prefix="quern-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "quern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f.name)
    atexit.register(lambda: Path(f.name).unlink(missing_ok=True))
    sc._quern_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir.

    Only a plain local master, where driver and executors are one process, may fall back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


class Stored:
    """A result written once to the shared folder; ``df`` reads it, ``drop`` removes it."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/quern-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _written.remove((self.spark, self.path))
        _delete(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    return Stored(df).df


def in_force(df: DataFrame, key: str, version: str) -> DataFrame:
    """For each ``key`` the row with the latest ``version``.

    Rows without key are left out. A null version counts as the oldest. Rows that tie on the version are told apart by a
    hash of all their columns, so that the choice does not depend on their order.
    """
    cols = df.columns
    # maps can not be hashed as such
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])
    rank = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.col(f"`{version}`").desc_nulls_last(), tie)
    return df.where(F.col(f"`{key}`").isNotNull()).withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").select(*[F.col(f"`{c}`") for c in cols])


def blank(c):
    """Null, empty or white space only."""
    return c.isNull() | (F.regexp_replace(c, r"[\s\p{Z}]+", "") == "")
