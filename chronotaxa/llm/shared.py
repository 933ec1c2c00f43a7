"""Plumbing that several training-data operators need: staged tables and Arrow passes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset, one in the warehouse, or a temporary one if there is only this machine."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None
        _FALLBACK[app] = tempfile.mkdtemp(prefix="chronotaxa-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget_all() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # noqa: BLE001  the session may be gone already
            break
    for spark, path in _STAGED:
        try:
            _forget(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class Stage:
    """Intermediate results as Parquet in the shared folder.

    A written table cuts the lineage, survives lost executors and is read back with
    column pruning. ``drop`` deletes what no later plan reads; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _STAGED.append((spark, self.root))

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def write_bucketed(self, df: DataFrame, by: str, n: int, name: str = "t") -> DataFrame:
        """As ``write``, in ``n`` buckets of ``by``: what is grouped by that column later is not shuffled again."""
        self.count += 1
        path, table = f"{self.root}/{self.count}-{name}", f"{name}_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(table)
        _TABLES.append((self.spark, table))
        out = self.spark.table(table)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _forget(self.spark, t._stage_path)

    def sweep(self) -> None:
        """Lets Spark delete shuffle files of finished jobs now rather than at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


ROWS = 512


def pieces(batch: pa.RecordBatch, rows: int = ROWS):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Returns freed memory to the system: a worker stays for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def arrow_pass(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batches)`` yields dicts of columns. It gets batches of at most ``ROWS`` rows, so that what it makes of one stays small."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in fn(piece for batch in batches for piece in pieces(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed train and held-out split."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n
