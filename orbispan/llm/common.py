"""Plumbing shared by the corpus operators: tables, scratch space, keyed runs of rows, hot-group grids, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbispan.operators.runs import map_runs
from orbispan.scratch import scratch_dir
from orbispan.shipping import ship

#: Rows that may be broadcast without a further check; each such table has at most a few fixed-width columns.
BROADCAST_ROWS = 100_000

__all__ = ["BROADCAST_ROWS", "Forest", "components", "drop_stored", "fresh", "join_small", "map_arrow", "map_runs", "read_table", "scratch_dir", "ship", "stored", "texts_of", "utf8_bytes", "with_grid"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors. A task gives its spare memory back when it ends, as its Python
    worker goes on to others."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/orbispan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbispan_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by stored() that nothing reads any more."""
    path = df._orbispan_path
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Broadcast `small` only if its counted rows are few; beyond that Spark shuffles (AQE splits skewed keys)."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# --- hot groups -----------------------------------------------------------------------------------------------------


def with_grid(df: DataFrame, key: str, ident: str, cap: int) -> DataFrame:
    """Deal each group's rows to cells so that every pair of a group's rows meets in exactly one bounded cell.

    A group of at most `cap` rows is one cell. A larger one is cut into k = ceil(n / cap) parts by a hash of `ident`;
    cell (a, b), a <= b, gets parts a and b. Adds cell_a, cell_b and part. Nothing is dropped or capped: a hot group
    costs more cells, not a larger task.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    sizes = stored(sizes.select(key, F.ceil(F.col("_n") / cap).cast("int").alias("_k")), "hot-groups")
    n_hot = sizes.count()
    if not n_hot:
        return df.withColumns({"cell_a": F.lit(0), "cell_b": F.lit(0), "part": F.lit(0)})
    dealt = join_small(df, sizes, [key], "left", n_hot).withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.col(ident), F.lit(97)), F.col("_k")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return dealt.withColumns({"cell_a": F.least("part", "_o"), "cell_b": F.greatest("part", "_o")}).drop("_k", "_o")


class Forest:
    """Union-find over the rows of one bounded cell; the smaller label becomes the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        """A link from each joined row to its root: as connected as all links, but linear in number."""
        src = [x for x in self.up if self.root(x) != x]
        return src, [self.root(x) for x in src]


# --- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each vertex of `edges` (src, dst: long): columns node, component.

    Alternating large-star and small-star rounds; links stay in Spark and each round is one stored table. A star's
    minimum is found by a partial aggregate and joined back, so a hub with most links is no single task.
    """
    spark = edges.sparkSession
    cur = stored(edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    mark = _signature(cur)
    for _ in range(max_rounds):
        both = cur.select("src", "dst").union(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        new = stored(small.where("src <> dst").distinct(), "links")
        drop_stored(cur)
        cur, old = new, mark
        mark = _signature(cur)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def utf8_bytes(text: str | Column) -> Column:
    """Length of a text in UTF-8 bytes; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def texts_of(column: pa.Array, step: int = 128) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a text column as Python strings, a few at a time."""
    for lo in range(0, len(column), step):
        yield lo, column.slice(lo, step).to_pylist()
