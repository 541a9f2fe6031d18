"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Entries of a look-up table of words. A worker holds those of one operator at a time (``sole``), so this bounds its memory in a pipeline too.
MOST_KEPT = 300_000
_held: list[dict] = []


def sole(*tables: dict) -> None:
    """Say whose look-up tables this worker uses from now on; those of the operator before it are emptied.

    Spark hands a worker from stage to stage, and with it what its modules hold.
    """
    if not _held or _held[0] is not tables[0]:
        for table in _held:
            table.clear()
        _held[:] = tables


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that driver and executors share.

    The folder comes from ``spark.checkpoint.dir``; only where a session names
    none and runs on one machine (tests) is a temporary one set. A cluster
    without one is an error, since executors would write where nobody else reads.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand Python at most ``BATCH_BYTES`` at once, or less where the session says so: texts may be very long.

    The session's own bound of 64 MB costs an executor of two cores some 500 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lots(batch: pa.RecordBatch, rows: int = 512, most: int = 8 << 20):
    """A batch in slices of at most ``rows`` rows, fewer where rows are long."""
    step = max(1, min(rows, most * batch.num_rows // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def map_batches(df: DataFrame, function, schema: str, rows: int = 512) -> DataFrame:
    """``df.mapInArrow`` for a function that turns a dict of Python lists into a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lot in lots(batch, rows):
                out = function(lot.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text; rows that are equal in both share them, nulls differ from empty values."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws(" ", mark(id_col), mark(text_col))))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(id, component)``.

    ``component`` is the smallest id that can be reached. Each round hooks every
    label to the smallest label next to it and then jumps along the labels;
    rounds end when nothing changes. Labels are written after each round. Nodes
    that no edge names are absent; an empty edge table gives an empty result.
    """
    both = edges.where("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(max_rounds):
        # the smallest label among each node's neighbours, offered to the node's own label
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        offers = labels.join(seen, labels.id == seen.a, "left").select("id", "component", F.least("near", "component").alias("low"))
        hooks = offers.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("low"))
        hooked = labels.join(hooks, labels.component == hooks.root).select("id", F.col("component").alias("old"), "low")
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        new = written(hooked.join(jump, "low", "left").select("id", "old", F.least(F.col("low"), F.coalesce("next", "low")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        forget(labels)
        labels = new.select("id", "component")
        if not changed:
            forget(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
