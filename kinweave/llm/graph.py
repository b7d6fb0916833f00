"""Connected components of very large graphs: of given edges, or of links that are found in cells of rows, without gathering a cell or a component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), both long: nodes with one root are connected.

    Every round each node points at the first of itself and its neighbours, in a random order that is new every other round, and edges
    move to what their ends point at, two steps on; what becomes a loop goes. Stars are done in two rounds, and a fixed share of the
    nodes is expected to go in a round on long chains too, so rounds grow with the logarithm of the largest component. A root is some
    node of its component. Nodes with very many edges cost no more than others: minima are combined before the shuffle, and the joins
    are plain equi-joins that Spark splits where one key has many rows. An empty edge list gives an empty table.
    """
    left = common.cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    steps: list[DataFrame] = []
    while not steps or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(c, F.lit(len(steps) // 2))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("b"), F.min(order("b")).alias("h"))
        points = near.select("node", F.when(F.col("h") < order("node"), F.col("b")).otherwise(F.col("node")).alias("root"))
        step = common.cut(points.alias("x").join(points.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", "y.root"))
        to = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))  # noqa: B023, E731
        left = common.cut(left.join(to("a"), "a").join(to("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
        steps.append(step)
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.alias("l").join(step.alias("s"), F.col("l.root") == F.col("s.node"), "left").select("l.node", F.coalesce("s.root", "l.root").alias("root"))
    return labels


def shared_cells(cells: DataFrame) -> DataFrame:
    """The rows of cells (cell, id, more columns) whose cell has several ids. Of cells with the same ids one is kept."""
    mark = (F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    several = cells.groupBy("cell").agg(F.count("*").alias("n"), *mark).where("n > 1")
    one = several.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell")
    return common.cut(cells.join(one, "cell"))


def linked(members: DataFrame, links: Callable[[DataFrame], DataFrame], per_row: int) -> DataFrame:
    """(node, root) of the ids that have links; nodes with one root are connected by links.

    members: (cell, id, more columns), each id once in a cell. links: gives the links among pairs (cell, a, b, the more columns with _a
    and _b appended); in a cell a pair comes once. Every pair of ids that
    share a cell is handed to it, unless links found before connect its ends already, which leaves the components as they are. A cell
    with up to `per_row` pairs a row gives all of them at once. In larger cells some rows lead, one in the first round and about eight
    times as many in each later one; they are paired with all others and then leave the cell, as do rows in time that links connect with all the
    rest. So a cell of like rows is done after a few rounds with a few pairs a row, no cell emits all its pairs at once, and none
    needs to fit into a task. Joins are plain equi-joins on the cell, which Spark splits where one cell has many rows.
    """
    more = [c for c in members.columns if c not in ("cell", "id")]
    left, groups, round_ = members.withColumn("root", F.col("id")), None, 0
    while True:
        rank = F.xxhash64("id", F.lit(round_))
        sized = left.groupBy("cell").agg(F.count("*").alias("n"), F.min(rank).alias("first")) if groups is None else (
            left.groupBy("cell", "root").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
            .groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.min("first").alias("first")).where("roots > 1").drop("roots")
        )
        all_ = F.col("n") - 1 <= 2 * per_row
        leads = (rank == F.col("first")) | (F.pmod(F.xxhash64(F.lit(round_), "id"), F.col("n")) < 8**round_)
        held = common.cut(left.join(sized, "cell").select("cell", "id", "root", *more, all_.alias("whole"), (leads & ~all_).alias("leads")))
        of = held.where("whole or leads").select("cell", F.col("id").alias("other"), F.col("root").alias("other_root"), *[F.col(c).alias(f"{c}_b") for c in more])
        pairs = held.join(of, "cell").where("root <> other_root and (id > other or not (whole or leads))").select("cell", F.col("id").alias("a"), F.col("other").alias("b"), *[x for c in more for x in (F.col(c).alias(f"{c}_a"), F.col(f"{c}_b"))])
        good = common.cut(links(pairs).select("a", "b"))
        rest = held.where("not whole and not leads").select("cell", "id", "root", *more)
        round_ += 1
        if groups is None or not good.isEmpty():
            # links so far as stars: as many edges as hold the components together
            if groups is not None:
                good = good.unionByName(groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            groups = common.cut(components(good))
        if rest.isEmpty():
            return groups
        named = groups.select(F.col("node").alias("id"), F.col("root").alias("named"))
        left = common.cut(rest.join(named, "id", "left").select("cell", "id", F.coalesce("named", "id").alias("root"), *more))
