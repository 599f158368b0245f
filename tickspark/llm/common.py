"""Helpers shared by the text operators."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.sources.scratch import checkpoint_dir, remove, scratch

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of a batch of rows that goes to a Python worker; every task has a few such batches at a time, in and beside the JVM.
ARROW_BATCH, ARROW_DEFAULT = "8m", 64 << 20


def small_batches(spark: SparkSession, size: str = ARROW_BATCH) -> None:
    """Texts are long: batches of the default 64 MB would take most of an executor's memory. A size set by the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(ARROW_DEFAULT), f"{ARROW_DEFAULT}b", "64m", "64MB", ARROW_BATCH):
        spark.conf.set(key, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """array<string> of the maximal runs of non-space characters; empty for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), "")


def whole(docs: DataFrame) -> DataFrame:
    """Every row as one struct beside its text, so that no column of the table clashes with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))


def with_text(rows: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of ``whole`` rows again with a new text; n_chars, if it is one of them, follows where the text changed."""
    old = {c: F.col("__row").getField(c) for c in columns}
    n = F.when(changed, F.length("__text").cast("long")).otherwise(old["n_chars"]) if "n_chars" in old else None
    new = {"text": F.col("__text"), "n_chars": n}
    return rows.withColumn("__text", text).select(*[new.get(c, old[c]).alias(c) if c in ("text", "n_chars") else old[c].alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir."""
    return checkpoint_dir(spark)


def give_back(spark: SparkSession) -> str | None:
    """Has the driver's JVM return to the system what it has freed outside its heap; what it says, None if it has no such command.

    Compiling and planning take such memory on hundreds of threads, and the C library would keep it for each of them.
    """
    try:
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, StopIteration):  # an older JVM, or one of another make
        return None


def settled(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors.

    small: rows are gathered into files of the advisory size first, for tables of few bytes from many tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.hint("rebalance") if small else df).write.option("compression", "zstd").parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_settled_at"] = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes a settled table that nothing reads any more."""
    if df is not None and "_settled_at" in df.__dict__:
        remove(df.sparkSession, df.__dict__["_settled_at"])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan(arr: Column, op: str = "sum", block: int = 128) -> Column:
    """Inclusive running sum or max of an array<bigint>, in two levels so that long arrays stay far from quadratic.

    An empty array gives an empty array; null elements are not allowed.
    """
    join = (lambda a, b: a + b) if op == "sum" else (lambda a, b: F.greatest(a, b))
    none = F.array().cast("array<bigint>")

    def run(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("last"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = join(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(a, start, step, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / block).cast("int")), lambda b: run(F.slice(arr, b * block + 1, block)))
    ends = run(F.transform(blocks, lambda b: F.element_at(b, -1)))
    lifted = F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda b, base: F.transform(b, lambda x: join(x, base))))
    return F.when(F.size(arr) == 0, none).when(F.size(arr) <= block, run(arr)).otherwise(lifted)
