"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once in a session.

    Python workers then find it whatever their working folder; the driver
    serves the file, so no folder need be shared for it.
    """
    context = spark.sparkContext
    if getattr(context, "_kunits_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="kunits-code-")) / "kunits_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"kunits/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._kunits_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder of intermediate tables that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one; a cluster session is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kunits-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows of a part, about, where a step sorts or groups many narrow rows.
ROWS_AT_ONCE = 500_000


def parts_of(df: DataFrame, rows: int = ROWS_AT_ONCE) -> int:
    """Parts to deal *df* into, so that none grows with the table.

    Adaptive execution merges parts by their compressed bytes, of which a task
    that sorts or groups narrow rows holds many times as much; parts whose
    number is given stay.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


@dataclass
class Scratch:
    """Intermediate tables of one run, in a folder of its own: a table goes when its successor is written."""

    spark: SparkSession
    root: str = ""
    written: list[tuple[DataFrame, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = self.root or f"{shared_dir(self.spark)}/kunits/run-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write *df* as Parquet in the shared folder, read it again."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that :meth:`stored` gave and that nothing reads any more."""
        gone = [path for back, path in self.written if any(back is t for t in tables)]
        self.written = [x for x in self.written if x[1] not in gone]
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
