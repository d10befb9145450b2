"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session that runs on this machine alone gets a temporary folder; on a cluster that is an error,
    since executors would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="statemill-"))
    return _LOCAL[0]


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive lost executors.

    Results of an operator read its tables, so they stay until ``close`` (or the end of a ``with`` block) of the Scratch
    that the caller hands in; those that operators make for themselves are closed when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        path = self._paths.pop(id(df), None)
        if path:
            self._delete(path)

    def close(self) -> None:
        """Deletes all tables; afterwards nothing that reads them can run."""
        atexit.unregister(self.close)
        try:
            self._delete(self.base)
        except Exception:  # the session has ended already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tables of more bytes on disk are no broadcast side. Ids compress well: as a hash table, which the driver builds, they
#: take up to 35 times as much.
BROADCAST_BYTES = 1 << 18


def lookup(df: DataFrame) -> DataFrame:
    """``df`` as a join's side that is broadcast only if all it reads is small.

    Spark compares the size of compressed files with its threshold, so that at its default of 10 MB the driver would build
    hash tables of hundreds of MB. What a shuffle has measured is not compressed and needs no such care.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.hint("merge") if size > BROADCAST_BYTES else df


class Hot:
    """The frequent values of a column: those with more rows than two usual partitions, so fewer than there are partitions.

    ``join`` deals the rows of such a value to several tasks, each with a copy of the other side's row.
    """

    def __init__(self, df: DataFrame, column: str):
        self.spark = df.sparkSession
        n = shuffle_partitions(self.spark)
        counts = df.groupBy(F.col(column).alias("__hot")).agg(F.count("*").alias("__n"))
        rows = df.count()
        most = max(200, 2 * math.ceil(rows / n))
        found = counts.where(F.col("__hot").isNotNull() & (F.col("__n") > most)).select("__hot", F.ceil(F.col("__n") / most).cast("int").alias("__salts"))
        self.rows = [(r[0], r[1]) for r in found.collect()] if rows > most else []
        self.schema = found.schema

    def _salted(self, df: DataFrame, column: str, salt) -> DataFrame:
        hot = F.broadcast(self.spark.createDataFrame(self.rows, self.schema))
        return df.join(hot, df[column].eqNullSafe(hot["__hot"]), "left").withColumn("__salt", salt(F.coalesce("__salts", F.lit(1)))).drop("__hot", "__salts")

    def join(self, many: DataFrame, one: DataFrame, on: list[str], column: str, how: str = "inner", deal: str | None = None) -> DataFrame:
        """``many`` with its match in ``one`` (unique by ``on``, which holds ``column``); ``deal``: a column of ``many`` that parts a hot value's rows."""
        if not self.rows:
            return many.join(one, on, how)
        dealt = self._salted(many, column, lambda n: F.pmod(F.xxhash64(*([deal] if deal else many.columns)), n).cast("int"))
        copied = self._salted(one, column, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
        return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected links (src, dst): rows (node, component), the smallest node reachable.

    Rounds of "take the smallest label among the neighbours, then the label of that label" until nothing changes.
    Aggregates are minima, which are combined before the shuffle; nodes with very many links, and labels of very many
    nodes, are dealt to several tasks (``Hot``). Labels that point at themselves, as in components that are done, are not
    looked up. Each round's labels are a table in the shared folder. Self links keep a node without partners in the
    result; null ends are dropped. The driver learns whether anything changed, and which nodes are hot.
    """
    ends = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    edges = scratch.save(ends.select(both.alias("e")).select("e.src", "e.dst").distinct())
    labels = scratch.save(edges.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("component")))
    hubs = Hot(edges, "dst")
    while True:
        near = hubs.join(edges, lookup(labels.withColumnsRenamed({"node": "dst"})), ["dst"], "dst", deal="src").select(F.col("src").alias("node"), F.col("component").alias("low"), F.lit(None).cast(labels.schema["component"].dataType).alias("old"))
        own = labels.select("node", F.col("component").alias("low"), F.col("component").alias("old"))
        step = scratch.save(near.unionByName(own).groupBy("node").agg(F.max("old").alias("old"), F.min("low").alias("mid")))
        if step.where("mid < old").isEmpty():
            scratch.drop(edges)
            scratch.drop(labels)
            return step.select("node", F.col("mid").alias("component"))
        jump = step.where("mid < node").select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        moved = Hot(step, "mid").join(step, lookup(jump), ["mid"], "mid", "left", deal="node")
        after = scratch.save(moved.select("node", F.coalesce("far", "mid").alias("component")))
        scratch.drop(step)
        scratch.drop(labels)
        labels = after


def joined_components(spark: SparkSession, labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, component) of ``components``, once more ``links`` (src, dst) join what they name: links are followed
    between components only, so that rounds are over as many rows as there are new links."""
    named = lambda end: lookup(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_low")))
    ends = links.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    outer = components(spark, ends.select(F.coalesce("src_low", "src").alias("src"), F.coalesce("dst_low", "dst").alias("dst")), scratch)
    lower = outer.select(F.col("node").alias("component"), F.col("component").alias("low"))
    moved = Hot(labels, "component").join(labels, lookup(lower), ["component"], "component", "left", deal="node")
    alone = outer.join(lookup(labels.select("node")), "node", "left_anti")
    return moved.select("node", F.coalesce("low", "component").alias("component")).unionByName(alone.select("node", "component"))
