"""What the operators share: the shared folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, one machine) a folder of our own is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


class Scratch:
    """Tables written to the shared folder, so that lost executors lose no work.

    ``keep`` writes a frame and reads it back; ``drop`` deletes one early. What is left
    goes when the application ends, as results may still read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
        self.at: dict[int, str] = {}
        self.made = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        to = self.path(f"{name}-{self.made}")
        df.write.option("compression", "zstd").parquet(to)
        back = self.spark.read.schema(df.schema).parquet(to)
        self.at[id(back)] = to
        return back

    def again(self, df: DataFrame) -> DataFrame:
        """The same table as a frame of its own, for joins of a table with itself."""
        return self.spark.read.schema(df.schema).parquet(self.at[id(df)])

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.delete(self.at.pop(id(df)))

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of steps whose frames are gone; else they wait for the driver's next collection."""
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.delete(self.root)
        except Exception:  # the session is gone and so may be its folders
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_worker(spark: SparkSession) -> Broadcast:
    """An empty broadcast dict. Each Python worker keeps its own copy from task to task, so what
    ``made_once`` puts there (a vocabulary, words already encoded) is made once a worker."""
    return spark.sparkContext.broadcast({})


def made_once(cell: Broadcast, make: Callable[[], object]):
    held = cell.value
    if "it" not in held:
        held["it"] = make()
    return held["it"]


class Remembered:
    """A bounded cache in two generations: what blocks of rows go on using stays, the rest is dropped."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """Of the distinct keys those that must be made; known ones are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        new = set(keys).difference(self.now)
        back = new & self.old.keys()
        self.now.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return list(new - back)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, at_once: int = 1000) -> Iterator[tuple]:
    """Rows of the named columns, with a bounded number of Python objects alive."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for start in range(0, batch.num_rows, at_once):
            yield from zip(*(c.slice(start, at_once).to_pylist() for c in columns), strict=True)


def text_blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[tuple[int, str]]]:
    """(doc_id, text) rows, a null text as empty, in lists of about ``chars`` characters."""
    block, size = [], 0
    for doc_id, text in rows_of(batches, "doc_id", "text", at_once=200):
        block.append((doc_id, text or ""))
        size += len(text or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


class Rows:
    """Gathers output rows and hands out record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 8 << 20):
        self.schema, self.limit = schema, limit
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.size += size
        return self.flush() if self.size >= self.limit else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = zip(*self.rows, strict=True)
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out
