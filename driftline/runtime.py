"""Session helpers shared by all operators.

Cluster rules kept here: lineage is cut by ``checkpoint()`` into the shared
folder named in ``spark.checkpoint.dir`` (a temporary folder is taken only by a
local session that names none, as in tests), and nothing is broadcast unless its size has
a proven bound.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "driftline", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIFTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file is one split, whatever work its rows make."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def fan_out(df: DataFrame) -> DataFrame:
    """``df`` evenly over all cores, for work that weighs more than its bytes (adaptive execution would merge small partitions)."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one of ``spark.checkpoint.dir``.

    A session that names none gets a temporary folder if it is local; on a
    cluster that is an error, as no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="driftline-")


def fresh(columns: list[str], stem: str) -> str:
    """A column name beginning with ``stem`` that is not in ``columns`` (names compare without case)."""
    taken = {c.lower() for c in columns}
    name, i = stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


def col(name: str) -> Column:
    """Column by exact name, also where the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank(c: Column) -> Column:
    """True for null, empty and all-white-space text (Unicode white space)."""
    return c.isNull() | c.rlike(r"(?U)\A\s*\z")


def tidy_path(c: Column) -> Column:
    """A path without surrounding white space and leading ``./``."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"^(?:\./+)+", "")


def lookup_salted(big: DataFrame, small: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) although a key may hold a third of ``big``.

    The rows of a key are counted first (or given as ``counts``: key, __n). Rows of a hot key are
    spread over salts and the one matching row of ``small``
    is replicated once per salt. A key is hot from ``rows / (2 * partitions)``
    rows, so at most ``2 * partitions`` keys are hot: that list is what gets
    broadcast. Many rows of a null key, which meet nothing, are spread too. Cold keys keep salt 0; without any hot key the join is a plain one.
    """
    spark = big.sparkSession
    n = partitions(spark)
    if counts is None:
        counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    floor = max((total or 0) / (2 * n), 10_000)
    if (most or 0) < floor:
        return big.join(small, key, how)
    salts = max(2, n)
    hot = F.broadcast(counts.filter((F.col("__n") >= floor) & col(key).isNotNull()).select(col(key).alias("__hot")))
    # The salt is a hash of the row, not a random number: a task that runs again after a loss gives the same one.
    own = F.xxhash64(*[col(c) for c, t in big.dtypes if "map<" not in t and "variant" not in t])
    left = big.join(hot, col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNull() & col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(own, F.lit(salts)).cast("int")))
    right = (
        small.join(hot, col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))))
        .drop("__hot")
    )
    return left.drop("__hot").join(right, [key, "__salt"], how).drop("__salt")
