"""Small helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import ensure_checkpoint_dir

# What one Arrow batch may hold: with rows of a few KB the byte bound rules, so a
# Python worker never sees more than this much text at once, plus one long row.
BATCH_BYTES = 4 << 20

# ASCII white space, the only separators of the word rule [^\x20\x09-\x0D]+ .
# bytes.split() without arguments splits on exactly these six characters.
_shipped: set[str] = set()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of ``df``: further columns, whatever their names, cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def whole_row(df: DataFrame):
    """All columns of ``df`` as one struct: a step may add its own columns beside it without a clash of names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def prepare(spark: SparkSession) -> None:
    """What a step with Python in its tasks needs: batches bounded by bytes, and this package on the executors."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = spark.conf.get(key).removesuffix("b")
    if current.isdigit() and int(current) > BATCH_BYTES:  # a size such as "64m" was set by the user and stays
        spark.conf.set(key, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    reachable = (os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    context = spark.sparkContext
    if str(root) in reachable or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="ledgerflow-")) / "ledgerflow.zip"  # the driver's own; Spark serves it to executors
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / "ledgerflow").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files that other tasks read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)
