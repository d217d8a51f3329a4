"""Shared storage for intermediate tables, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits for each key of a sieve, and 64-bit words of one at most (2 MB).
SIEVE_BITS, SIEVE_WORDS = 16, 1 << 18

_SHIPPED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one made for this session, but on local masters only: elsewhere executors wouldn't share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docpipe-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    at = f"{shared_dir(spark)}/docpipe/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # its codec holds no direct buffers until the next collection
    return spark.read.schema(df.schema).parquet(path)


def sieved(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, most: int = SIEVE_WORDS) -> DataFrame:
    """``df`` with all rows whose ``key`` is in ``wanted``, and without most of the others: for use before a join that shuffles.

    Both keys are of one type. A bit for the hash of each wanted key is broadcast, in ``most`` words at most, so beyond about a
    million keys more rows stay; a join has to follow in any case.
    """
    words = min(most, wanted.count() * SIEVE_BITS // 64 + 1)

    def place(of: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(of), F.lit(words * 64))
        return F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")

    i, n = place(wanted_key)
    held = wanted.select(i.alias("id"), n.alias("n")).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("word"))
    whole = df.sparkSession.range(words).join(held, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    bits = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("_sieve"))
    i, n = place(key)
    return df.join(F.broadcast(bits), F.getbit(F.get("_sieve", i), n) == 1, "left_semi")


def ship(spark: SparkSession) -> None:
    """Give Python workers this package: once per application, as a zip that Spark sends to executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    where = tempfile.mkdtemp(prefix="docpipe-ship-")
    target = os.path.join(where, "docpipe_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("docpipe", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target  # the file stays: executors that start later fetch it too
