"""Small helpers shared by the operators: word splitting on bytes, bounded Arrow slices, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.session import ensure_checkpoint_dir

#: Text bytes that one step of a vectorised task works on (a longer single text is worked on alone).
SLICE_BYTES = 4 << 20

#: Byte table: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))
#: Byte table: A-Z to a-z, nothing else.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z (UTF-8 bytes; null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z (UTF-8 bytes; null: none).

    ``bytes.split`` separates at exactly the six characters space, \\t, \\n, \\v, \\f and \\r.
    """
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes, so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's sources, as ``--py-files`` does, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_veritab_shipped", False):
        root = Path(__file__).resolve().parents[1]
        file = Path(tempfile.mkdtemp(prefix="veritab-")) / "veritab.zip"
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(file))
        sc._veritab_shipped = True


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn`` called on bounded slices of each batch."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)
    return df.mapInArrow(run, schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True where ``crc32(doc_id as text) mod 4`` is 2; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all machines of a cluster share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that ``written`` makes within the block, in the order in which they are made."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
    finally:
        _MADE.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``written`` made, once nothing that is still to run reads them."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
