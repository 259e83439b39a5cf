"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.session import ship


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary
    folder; a cluster session is refused, because executors couldn't see it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kunits-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write *df* as Parquet in the shared folder, read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kunits/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that *df* lacks, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_last: list[Callable[[], None]] = []


def _begun(forget: Callable[[], None]) -> None:
    """Drop what a worker keeps for the operator that it worked for before, if that was another."""
    if _last and _last[0] is not forget:
        _last.pop()()
    _last[:] = [forget]
    pa.default_memory_pool().release_unused()


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory of those that are done goes back to the system before the next is read."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def lean(forget: Callable[[], None]) -> Callable[[Callable], Callable]:
    """For functions of mapInArrow. Spark uses a worker again for other operators, and what each left behind would add up.

    A worker keeps the caches of one operator at a time: *forget*, a function
    of its module, drops them once a task of another begins. Between batches,
    and after the last, Arrow gives free memory back.
    """

    def of(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _begun(forget)
            yield from run(_in_turn(batches))
            pa.default_memory_pool().release_unused()

        return task

    return of


def text_key(text: str | F.Column) -> F.Column:
    """128-bit key of a text as hex; null texts share the key of no text at all."""
    column = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(column.cast("binary"), F.lit(b"").cast("binary")))


