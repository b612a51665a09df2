"""Session helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
from collections.abc import Sequence
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of cells (rows x values per row) a broadcast side may hold.
BROADCAST_CELL_LIMIT = 2_000_000


def fallback_folder(master: str, warehouse: str) -> str:
    """Where intermediate tables go if no folder is named: beside the warehouse.

    On a cluster a local path is refused: each executor would write to a disk of its own.
    """
    local = master.split("[")[0] == "local"
    if not local and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_scratch"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else one under the warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or fallback_folder(context.master, spark.conf.get("spark.sql.warehouse.dir")))
    return context.getCheckpointDir()


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tablegauge/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


_OWNED: set[str] = set()


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the application's part of the shared folder, which goes when the application ends."""
    root = _scratch_root(spark)
    if root not in _OWNED:
        system, path = _file_system(spark, root)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWNED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whatever store it names?"""
    system, path = _file_system(spark, path)
    return system.exists(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written before."""
    system, path = _file_system(spark, _scratch_root(spark))
    system.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage and, unlike ``checkpoint()``, gives the optimizer the real size, so
    joins of loop results keep sane estimates.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, cells_per_row: int = 1,
                       limit: int = BROADCAST_CELL_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is left to a shuffle join.

    ``df`` should be materialized or cheap, as the check runs a bounded count.
    """
    max_rows = max(1, limit // max(1, cells_per_row))
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, keys: list[str], n_groups: int, groups_per_task: int = 2000) -> DataFrame:
    """Hash-partition by ``keys`` for work that costs much per group and little per byte.

    Adaptive execution would merge such partitions because they are small; an explicit
    number is kept.  A later grouping by ``keys`` needs no further shuffle.
    """
    spark = df.sparkSession
    wanted = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")),
                 -(-n_groups // groups_per_task))
    return df.repartition(max(1, min(n_groups, wanted)), *keys)


def match_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a null equal to a null; the key columns are those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def fold(single_rows: list[DataFrame]) -> DataFrame:
    """Put one-row results side by side without a join."""
    names = list(dict.fromkeys(c for df in single_rows for c in df.columns))
    stacked = single_rows[0]
    for df in single_rows[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors and not on their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="tablegauge-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
