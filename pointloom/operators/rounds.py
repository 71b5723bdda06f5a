"""Tables between the rounds of a loop; components of a graph, and places in an order, without a task that sees all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names (a local one on a local master)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-rounds-"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to broadcast, once it is known to have at most ``most`` rows."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table of more than {most} rows can't be paired with all rows")
    return F.broadcast(df)


def with_few(df: DataFrame, few: DataFrame, on: str | list[str], most: int = 100_000) -> DataFrame:
    """An inner join with a table that is worked out first; rows of ``df`` stay where they are if it has at most ``most`` rows."""
    few = save(few)
    return df.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, on)


#: Edges that are put into stars at once.
PIECE = 1 << 20


def _stars(batches):
    """Of each PIECE of one task's edges (group, a, b): each node with the least node of its component among these edges."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            held.append(batch.slice(at, PIECE))
            n += held[-1].num_rows
            if n >= PIECE:
                yield _star(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield _star(pa.Table.from_batches(held))


def _star(table):
    import numpy as np
    import pyarrow as pa

    group, a, b = (table.column(c).to_numpy() for c in ("group", "a", "b"))
    nodes, at = np.unique(np.stack((np.concatenate((group, group)), np.concatenate((a, b)))), axis=1, return_inverse=True)
    at = at.reshape(-1)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(nodes.shape[1])
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):  # the label's own node takes the lesser label too
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(nodes[0][keep]), pa.array(nodes[1][keep]), pa.array(nodes[1][label[keep]])], names=["group", "a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(group, node, label) of the nodes of edges (group, a, b), the label being the least node of its component.

    Nodes that are their own label have no row; group and nodes are longs. The edges are dealt out by ranges of their
    nodes and sorted, and each task first puts the components of its own edges into stars, piece by piece. Large-star and small-star steps then go
    on until all edges are stars: each takes time in proportion to the edges, and their number grows with the logarithm
    of the number of pieces that a component lies in.
    """
    edges = edges.where("a <> b").select(F.col("group").cast("long"), F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = save(edges.repartitionByRange("group", "b").sortWithinPartitions("group", "b").mapInArrow(_stars, "group long, a long, b long"))
    while True:
        both = edges.union(edges.select("group", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("group", "a").agg(F.min("b").alias("m")).select("group", "a", F.least("a", "m").alias("m"))
        large = both.join(least, ["group", "a"]).where("b > a").select("group", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("group", "a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = save(large.join(low, ["group", "a"]).select("group", F.explode(pair).alias("e")).select("group", "e.a", "e.b").where("a <> b").distinct())
        inner = edges.select("group", "a").union(edges.select("group", "b").distinct()).groupBy("group", "a").count()
        if not inner.where("count > 1").head(1):  # each node has one label, which has none itself
            return edges.select("group", F.col("a").alias("node"), F.col("b").alias("label"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums in an order (this row's share included); rows are dealt out by ranges of the order.

    The one window over everything runs over a row for each range.
    """
    parts = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    names = list(sums)
    totals = parts.groupBy("_part").agg(*[F.sum(sums[n]).alias(f"_t{i}") for i, n in enumerate(names)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_part")  # a row for each range
    return out.select(*df.columns, *[(F.sum(sums[n]).over(upto) + F.col(f"_o{i}")).alias(n) for i, n in enumerate(names)])


def running_within(
    df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, Column] | None = None, previous: dict[str, Column] | None = None
) -> DataFrame:
    """Adds running sums within groups in an order (this row's share included); null is a group of its own.

    ``totals``: sums over the whole group. ``previous``: values of the row before in the group, null in its first row
    (these need an ascending order that tells all rows of a group apart).

    Rows are dealt out by ranges of group and order, so a group of any size is shared among tasks, each of which sums its
    own range. At most as many groups as there are ranges lie in more than one; for these alone, the sums of the other
    ranges are added. All tables that are broadcast have a few rows for each range.
    """
    totals, previous = totals or {}, previous or {}
    parts = save(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *order).withColumn("_part", F.spark_partition_id()))
    key = F.struct(*group)
    ends = parts.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # groups lie in the ranges one after the other
    cut = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_g")).groupBy("_g").count().where("count > 1").select("_g")
    each = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())] + [F.sum(c).alias(f"_t{i}") for i, c in enumerate(totals.values())]
    each += [F.max_by(F.struct(c.alias("v")), F.struct(*order)).alias(f"_p{i}") for i, c in enumerate(previous.values())]
    shares = parts.withColumn("_g", key).join(F.broadcast(cut), "_g").groupBy("_g", "_part").agg(F.count("*").alias("_n"), *each)
    line = Window.partitionBy("_g").orderBy("_part")
    before, whole = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_g")
    others = shares.select(
        "_g", "_part", F.lit(True).alias("_cut"), *[F.sum(f"_s{i}").over(before).alias(f"_s{i}") for i in range(len(sums))],
        *[F.sum(f"_t{i}").over(whole).alias(f"_t{i}") for i in range(len(totals))], *[F.lag(f"_p{i}").over(line).alias(f"_p{i}") for i in range(len(previous))],
    )
    out = parts.withColumn("_g", key).join(F.broadcast(others), ["_g", "_part"], "left")
    place = Window.partitionBy("_part", *group).orderBy(*order)
    upto, all_here = place.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_part", *group)
    return out.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.coalesce(F.col(f"_s{i}"), F.lit(0))).alias(n) for i, (n, c) in enumerate(sums.items())],
        *[F.when(F.col("_cut"), F.col(f"_t{i}")).otherwise(F.sum(c).over(all_here)).alias(n) for i, (n, c) in enumerate(totals.items())],
        *[F.coalesce(F.lag(F.struct(c.alias("v"))).over(place), F.col(f"_p{i}"))["v"].alias(n) for i, (n, c) in enumerate(previous.items())],
    )
