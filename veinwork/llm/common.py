"""Shared helpers of the training-data operators.

Conventions that hold for every operator here:

* ``docs`` is any DataFrame with ``doc_id`` and ``text``; further columns pass
  through untouched. An input column whose name an operator also produces is
  replaced by the operator's one.
* A null text has no words, bytes or lines; it never fails.
* Rows are told apart by ``doc_id`` and text. Rows equal in both are copies of
  one row: each gets the same verdict.
"""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six white-space bytes that end a word, for Spark's and Java's patterns.
SPACE = "[ \\t-\\r]"
NOT_SPACE = "[^ \\t-\\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch: texts are whole, so the default of 10,000 would hold too much of them.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, under ``spark.checkpoint.dir``.

    The folder is the cluster's; only a local session without one (a test) gets its own.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veinwork-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared folder of ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle and checkpoint files of frames that are out of use.

    Its cleaner acts when the driver's JVM collects garbage, which small plans
    never cause; without this, every finished step's files stay to the end.
    """
    gc.collect()
    spark._jvm.System.gc()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to produce."""
    clash = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in clash])


def sheltered(*own: str):
    """Decorate an operator of ``docs`` so that it sees the columns ``own`` and one more, which holds all others.

    So its internal names can't clash with an input's. The result has the
    input's columns in their order, then those that the operator adds; an input
    column of the same name as one of these is replaced by it.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            rest = [c for c in docs.columns if c.lower() not in own]
            held = [c for c in docs.columns if c.lower() in own]
            if not rest:
                return f(docs, *args, **kwargs)
            packed = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest_")
            out = f(docs.select(*[quoted(c) for c in held], packed), *args, **kwargs)
            made = [c for c in out.columns if c not in held and c != "rest_"]
            names = {c.lower() for c in made}
            old = [quoted(c) if c in held else F.col(f"rest_.c{rest.index(c)}").alias(c) for c in docs.columns if c.lower() not in names]
            return out.select(*old, *[quoted(c) for c in made])

        return run

    return wrap


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that ``df`` has, for an operator's internal columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(text: Column | None = None, doc_id: Column | None = None) -> Column:
    """What tells rows apart: the doc_id and 64 bits of the text, null-safe."""
    text = F.col("text") if text is None else text
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.struct(doc_id.alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("th"))


def append_columns(docs: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[list], dict[str, pa.Array]]]) -> DataFrame:
    """Add columns computed from the text in Python, batch by batch.

    ``make()`` runs once in each task and returns a function from the batch's
    texts (str or None) to Arrow arrays by column name.
    """
    docs = without(docs, [f.name for f in fields])
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for k in range(0, max(1, batch.num_rows), BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                new = work(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(new[f.name] for f in fields)], names=[*part.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, schema)


def arrow_batches(spark: SparkSession) -> None:
    """Prepare a session for Python operators: Arrow batches bound in rows and bytes, and this package on the executors.

    This sets two options of the session where they have their defaults.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_veinwork_shipped", None) is None:
        context._veinwork_shipped = _archive()
        context.addPyFile(context._veinwork_shipped)


def _archive() -> str:
    """The package as a zip file, which the driver serves to executors that don't have it installed."""
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="veinwork-code-")) / "veinwork.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return str(target)
