"""Helpers shared by the training-data operators: table access, the shared
work folder, code shipping and Arrow mapping."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows and bytes that go to a Python worker at once; bounds its memory.
BATCH_ROWS, BATCH_BYTES = 20000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a session in local mode names none, as in tests, a temporary
    folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="nearfold-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block; those of the caller come back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Workspace:
    """Named intermediate tables of one operator call in the shared folder.

    Written tables cut lineage: a lost executor costs one re-read, never a
    recomputation of the Python stage that made the rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/nearfold/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        # Shuffle files of a written table have no reader left, but would stay until the driver collects garbage.
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nearfold_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that this workspace wrote and nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._nearfold_path)
            path.getFileSystem(conf).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a Spark application, so that
    Python workers import it whatever their own path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[2]
    fd, name = tempfile.mkstemp(prefix="nearfold-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "nearfold").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(name)


#: Bytes that a worker may hold beyond those it began with before it gives back what is free.
SPARE = 48 << 20
_began: list[int] = []
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What a module keeps in a worker from task to task; emptied when another module's function runs there."""
    return _kept.setdefault(module, {})


def resident() -> int:
    """Bytes of memory that this process has for itself; 0 where that can't be told."""
    try:
        pages = Path("/proc/self/statm").read_text().split()
    except OSError:
        return 0
    return (int(pages[1]) - int(pages[2])) * os.sysconf("SC_PAGESIZE")


def give_back() -> None:
    """What the allocators hold free goes back to the system; else a process stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _lean(batches, fn):
    """``fn``'s batches. Workers outlive their tasks and wait beside those of other stages, so each gives back what it no longer needs."""
    home = getattr(fn, "func", fn).__module__
    for module, held in _kept.items():
        if module != home:
            held.clear()
    if not _began:
        _began.append(resident())
    try:
        yield from fn(batches)
    finally:
        if resident() > _began[0] + SPARE:
            give_back()


def pieces(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices of at most ``most`` bytes of a string column, and one row more."""
    n = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // most)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
        yield batch.slice(i, j - i)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; ``fn`` takes and gives an iterator of record batches."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(partial(_lean, fn=fn), schema)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column as str; null is empty."""
    return [x or "" for x in column.to_pylist()]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fold_words(text: bytes) -> list[bytes]:
    """Lower-cased words with ASCII punctuation at no place; for matching, not for counting."""
    return text.lower().translate(_FOLD).split()


_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def row_key(*columns: str):
    """A column of 128 bits that tells rows apart even where doc_id is null or repeated.

    Rows equal in the named columns share a key and get equal treatment.
    """
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ..., so that no name of its own can clash with a helper column's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
