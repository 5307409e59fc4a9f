"""A stored adjacency of a graph: a node's neighbours in blocks, opened by node; expansion by frontier, hubs over many tasks.

build() writes two tables in folders by a hash of the node, sorted by it. `nodes` has a row for each node: its degree and the
number of its blocks. `blocks` has a row for each block: some BLOCK neighbours with weights, in order. Which block a neighbour is
in goes by its hash, so a hub's neighbours are never gathered in one task.

Questions for a few nodes open those nodes' folders only. A frontier goes to blocks, not to nodes: its rows are multiplied by
the blocks of the node they stand at, so a hub that a third of the frontier reaches is met block by block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh, kept
from .inverted import stamp_of

#: Neighbours of a block, folders of nodes, and nodes asked whose folders are looked up first.
BLOCK, FOLDERS, FEW = 4096, 32, 1000
_OPEN: dict[tuple, tuple[tuple, Adjacency]] = {}


def _folder(node: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(folders)).cast("int")


class Adjacency:
    """An adjacency in its folder. nodes: (node, degree, weight, blocks, folder), blocks: (node, block, neighbours, folder)."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path, folders
        self.nodes = spark.read.schema("node string, degree long, weight long, blocks int, folder int").parquet(f"{path}/nodes")
        self.blocks = spark.read.schema("node string, block int, neighbours array<struct<id:string,weight:long>>, folder int").parquet(f"{path}/blocks")

    def _opened(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, blocks), only the folders of the nodes asked where these are few. asked: written already."""
        few = asked.select("node").distinct().limit(FEW + 1).select(_folder(F.col("node"), self.folders).alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()  # a row a folder
        if sum(r["n"] for r in few) > FEW:
            return self.nodes, self.blocks
        within = F.col("folder").isin(*(r["f"] for r in few)) if few else F.lit(False)
        return self.nodes.filter(within), self.blocks.filter(within)

    def neighbours(self, asked: DataFrame) -> DataFrame:
        """asked with (id, weight) of each neighbour. asked: (node, ...) written or small; rows that repeat are answered each."""
        nodes, blocks = self._opened(asked)
        at = asked.join(nodes.select("node", "blocks"), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return at.join(blocks.drop("folder"), ["node", "block"]).select(*asked.columns, F.inline("neighbours"))

    def of(self, *nodes: str) -> DataFrame:
        """(node, id, weight) of some nodes."""
        return self.neighbours(self.spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node string"))

    def expanded(self, seeds: DataFrame, hops: int) -> DataFrame:
        """(seed, id, hop): every node within `hops` steps of each seed, with the fewest steps it takes; a seed itself at 0. seeds: (seed, node); a seed may start at several nodes, and nodes that the graph lacks stay alone."""
        reached = kept(seeds.filter("node is not null").select("seed", F.col("node").alias("id"), F.lit(0).alias("hop")).distinct(), "reached")
        frontier, parts = reached, [reached]
        for hop in range(1, hops + 1):
            met = self.neighbours(frontier.select("seed", F.col("id").alias("node"))).select("seed", "id", F.lit(hop).alias("hop"))
            # a step leads back at most one level: what is two levels behind was all met by then
            for part in parts[-2:]:
                met = met.unionByName(part)
            frontier = kept(met.groupBy("seed", "id").agg(F.min("hop").alias("hop")).filter(F.col("hop") == hop), "reached")
            if frontier.isEmpty():
                break
            parts.append(frontier)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def build(edges: DataFrame, path: str | None = None, block: int = BLOCK, folders: int = FOLDERS) -> Adjacency:
    """Write the adjacency of undirected edges (source, target, weight long); repeated edges add up, an edge to itself is one neighbour, edges with a null end go."""
    spark = edges.sparkSession
    path = path or fresh(spark, "adjacency")
    whole = edges.filter("source is not null and target is not null").select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.coalesce("weight", F.lit(0)).cast("long").alias("w"))
    both = whole.unionByName(whole.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    each = kept(both.groupBy(F.col("a").alias("node"), F.col("b").alias("id")).agg(F.sum("w").alias("weight")), "edges")
    nodes = each.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")).withColumn("blocks", F.ceil(F.col("degree") / block).cast("int")).withColumn("folder", _folder(F.col("node"), folders))
    nodes.repartition("folder").sortWithinPartitions("folder", "node").write.partitionBy("folder").parquet(f"{path}/nodes")
    placed = each.join(spark.read.schema("node string, blocks int, folder int").parquet(f"{path}/nodes").select("node", "blocks"), "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = placed.groupBy("node", "block").agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("neighbours")).withColumn("folder", _folder(F.col("node"), folders))
    lists.repartition("folder", F.col("block") % 4).sortWithinPartitions("folder", "node", "block").write.partitionBy("folder").parquet(f"{path}/blocks")
    return Adjacency(spark, path, folders)


def opened(spark: SparkSession, table: str, name: str, edges: Callable[[], DataFrame]) -> Adjacency:
    """The adjacency `name` made from a Parquet table: built on the first call of the session and when the table's files have changed, kept otherwise."""
    key, stamp = (spark.sparkContext.applicationId, table, name), stamp_of(spark, table)
    if key not in _OPEN or _OPEN[key][0] != stamp:
        _OPEN[key] = stamp, build(edges())
    return _OPEN[key][1]


#: Members of a group that are sent as one list, rows that one member may have in one task, buckets in which both are counted, and others counted in a task.
LISTED, AT_ONE, BUCKETS, COUNTED = 1 << 16, 1 << 20, 1 << 16, 1 << 21


def _crowded(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(_bucket, _parts): buckets of a column's values with more than `most` rows, and into how many parts to deal them."""
    counted = rows.groupBy(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("_bucket")).agg(F.count("*").alias("_n"))
    return counted.filter(F.col("_n") > most).select("_bucket", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))


def two_steps(edges: DataFrame, listed: int | None = None, at_one: int | None = None) -> DataFrame:
    """(member, near, far): for every member its groups, and the other members of those. edges: (member, grp), whole numbers; rows that repeat count once, a member without a group has that as one, and null is a member that shares nothing.

    For all nodes at once nothing has to be stored and opened by node: edges are dealt by group once, and each member gets the lists of its groups, where others are counted. Pairs of members are not shuffled one by one. Where buckets hold more, groups go in lists of about `listed` members, each of which meets each, and members with more than about `at_one` rows are counted in parts, by the others' hash."""
    listed, at_one = listed or LISTED, at_one or AT_ONE
    e = edges.select(F.col("member").cast("long").alias("member"), F.col("grp").cast("long").alias("grp"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    part = lambda x, n: F.pmod(F.xxhash64(F.lit("part"), x), n).cast("int")

    def spread(df: DataFrame, name: str, most: int, parts: str) -> DataFrame:
        """df with the number of parts of a column's bucket."""
        crowded = F.broadcast(_crowded(e, name, most))  # BUCKETS rows at most
        return df.withColumn("_bucket", bucket(name)).join(crowded, "_bucket", "left").withColumn(parts, F.coalesce("_parts", F.lit(1))).drop("_bucket", "_parts")

    whole = e.filter("member is not null and grp is not null")
    lists = spread(whole, "grp", listed, "lists").withColumn("list", part(F.col("member"), F.col("lists")))
    lists = kept(lists.groupBy("grp", "lists", "list").agg(F.collect_set("member").alias("members")), "lists")
    alone = lists.filter("lists = 1").select(F.explode("members").alias("member"), "members", F.lit(1).alias("own"))
    x, y = (lists.filter("lists > 1").select("grp", F.col("list").alias(k), F.col("members").alias(f"_{k}")) for k in "xy")
    met = x.join(y, "grp").select(F.explode("_x").alias("member"), F.col("_y").alias("members"), (F.col("x") == F.col("y")).cast("int").alias("own"))
    rows = spread(alone.unionByName(met), "member", at_one, "parts").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = F.when(F.col("parts") == 1, F.col("members")).otherwise(F.filter("members", lambda m: part(m, F.col("parts")) == F.col("place")))
    own = F.when(F.col("place") == 0, F.col("own")).otherwise(0)
    pairs = lists.agg(F.sum(F.size("members").cast("long") ** 2)).first()[0] or 0  # those of lists of one group with each other are not counted
    tasks = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // COUNTED) + 1)
    dealt = rows.select("member", "place", own.alias("own"), split.alias("members")).repartition(tasks, "member", "place")
    # others are told apart where their lists lie; a row without any keeps what is its own
    other = dealt.select("member", "place", "own", F.posexplode_outer("members").alias("at", "other"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    each = other.groupBy("member", "place", "other").agg(F.sum(F.when(first, F.col("own")).otherwise(0)).alias("own"))
    far = F.count_if(F.col("other") != F.col("member"))
    found = each.groupBy("member", "place").agg(F.sum("own").alias("near"), far.alias("far")).drop("place")
    none = e.filter("member is null or grp is null").distinct().groupBy("member").agg(F.count("*").alias("near"), F.lit(0).cast("long").alias("far"))
    return found.unionByName(none).groupBy("member").agg(F.sum("near").alias("near"), F.sum("far").alias("far"))
