"""Splits that keep tied records together: a Boruvka spanning forest, whose trees are dealt to the splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.engine import cut, drop
from parcelforge.operators.ordered import running_total
from parcelforge.operators.skew import lookup

GIANT = 1e-3  # a tree with more than this share of all rows is placed on its own: at most 1 / GIANT trees


def parent_name(base: Column, key: Column) -> Column:
    """The case that a base key names, however it is written (`case 12`, `0012`, `12.0`, ` 12 `); for a null or blank one, the key before its first `_`."""

    def plain(c: Column) -> Column:
        bare = F.regexp_replace(F.lower(c), r"^[\s ]+|[\s ]+$", "")
        number = F.regexp_extract(bare, r"^(?:case)?[\s :#._-]*0*(\d+)(?:\.0*)?$", 1)
        return F.when(number != "", number).otherwise(bare)

    given = plain(base)
    return F.when(given.isNull() | (given == ""), plain(F.substring_index(key, "_", 1))).otherwise(given)


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, trees) of edges (u, v, weight): the edges of a minimum spanning forest, and (vertex, tree) of every vertex with an edge.

    Boruvka: in each round every tree takes its minimum edge (by weight, then ends: a total order, so no cycles but
    the two trees that choose the same edge), the choices are followed to their roots by pointer jumping, and the edges
    are contracted; parallel ones leave only the least. Trees at least halve in number, so there are at most log2
    rounds, and each round's tables lie in the shared folder. `tree` is the name of one of the tree's vertices.
    Loops and edges with a null end are left out. Hot vertices are split on every join (lookup).
    """
    live = cut(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "weight")
        .groupBy("a", "b").agg(F.min(F.struct("weight", "a", "b")).alias("e")),
        "edges",
    )
    labels = cut(live.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("tree", F.col("vertex")), "labels")
    chosen: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("o"), "e"), F.struct(F.col("b").alias("t"), F.col("a").alias("o"), "e"))).alias("x")).select("x.*")
        least = cut(ends.groupBy("t").agg(F.min(F.struct("e", "o")).alias("m")).select("t", "m.o", "m.e"), "least")
        chosen.append(least.select("e.*").distinct())
        mutual = least.select(F.col("t").alias("o"), F.col("o").alias("t"), F.lit(True).alias("both"))
        up = cut(
            least.join(mutual, ["t", "o"], "left").select("t", F.when(F.col("both") & (F.col("t") < F.col("o")), F.col("t")).otherwise(F.col("o")).alias("up")), "up"
        )
        while True:
            higher = cut(lookup(up, up.select(F.col("t").alias("up"), F.col("up").alias("top")), "up").select("t", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            moved = not higher.where("moved").isEmpty()
            drop(up)
            up = higher
            if not moved:
                break
        roots = up.select(F.col("t").alias("tree"), F.col("up").alias("root"))
        new_labels = cut(lookup(labels, roots, "tree", "left").select("vertex", F.coalesce("root", "tree").alias("tree")), "labels")
        a = lookup(live, roots.select(F.col("tree").alias("a"), F.col("root").alias("ra")), "a", "left")
        b = lookup(cut(a.select("b", "e", F.coalesce("ra", "a").alias("x")), "half"), roots.select(F.col("tree").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = b.select("x", F.coalesce("rb", "b").alias("y"), "e").where("x <> y")
        contracted = cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "e").groupBy("a", "b").agg(F.min("e").alias("e")), "edges")
        drop(live), drop(labels), drop(up)
        live, labels = contracted, new_labels
    spark = edges.sparkSession
    forest = chosen[0] if chosen else spark.createDataFrame([], live.select("e.*").schema)
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    return forest, labels


def ties(df: DataFrame, key: str, base: str) -> DataFrame:
    """(key, parent, rows), stored: which keys have which parents, by how many rows. Rows with a null key tie nothing."""
    named = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), parent_name(F.col(f"`{base}`"), F.col(f"`{key}`")).alias("parent"))
    return cut(named.groupBy("key", "parent").agg(F.count(F.lit(1)).alias("rows")), "ties")


def tie_edges(tied: DataFrame) -> DataFrame:
    """(u, v, weight) of keys (k...) and parents (p...); heavier ties first."""
    return tied.select(F.concat(F.lit("k"), "key").alias("u"), F.concat(F.lit("p"), "parent").alias("v"), (-F.col("rows")).alias("weight"))


def groups(tied: DataFrame) -> DataFrame:
    """(key, group_key, members, rows), stored: the tree that each key is in, named by its least key in string order."""
    _, trees = spanning_forest(tie_edges(tied))
    rows = tied.groupBy("key").agg(F.sum("rows").alias("rows"))
    keyed = trees.where(F.col("vertex").startswith("k")).select(F.expr("substr(vertex, 2)").alias("key"), "tree")
    member = cut(keyed.join(rows, "key"), "member")
    named = member.groupBy("tree").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("members"), F.sum("rows").alias("group_rows"))
    return cut(lookup(member, named, "tree").select("key", "group_key", "members", "rows", "group_rows"), "groups")


def deal(grouped: DataFrame, targets: list[tuple[str, float]], seed: int = 17) -> DataFrame:
    """(group_key, split): one split for each group, so that the splits get about their shares of rows.

    grouped is (group_key, group_rows), one row per group. Groups beyond GIANT of all rows, of which there are at most
    1 / GIANT, go one by one, largest first, to the split that lacks most. The others are stratified by size band (powers
    of two) and each band, in hashed order, is dealt along its running total of rows in proportion to what the
    splits still lack; a band misses its shares by at most one of its groups. Shares are scaled to 1; a share that is
    null, negative or not finite is 0.
    """
    spark = grouped.sparkSession
    shares = {name: share if share is not None and 0 < share < float("inf") else 0.0 for name, share in targets}
    whole = sum(shares.values())
    if not whole:
        raise ValueError("no split has a share")
    names = sorted(shares)
    total = grouped.agg(F.sum("group_rows")).first()[0] or 0
    giants = grouped.where(F.col("group_rows") > total * GIANT).orderBy(F.desc("group_rows"), "group_key").collect()
    lack = {n: shares[n] / whole * total for n in names}
    placed = []
    for g in giants:
        to = max(names, key=lambda n: (lack[n], n))
        lack[to] -= g["group_rows"]
        placed.append((g["group_key"], to))
    open_ = {n: max(0.0, v) for n, v in lack.items()}
    left = sum(open_.values()) or 1.0
    small = grouped.where(F.col("group_rows") <= total * GIANT).withColumn("_band", F.floor(F.log2(F.greatest(F.col("group_rows"), F.lit(1)))).cast("int"))
    run = running_total(small, [F.xxhash64("group_key", F.lit(seed)), F.col("group_key")], F.col("group_rows"), "_run", within=["_band"], label="deal")
    sums = small.groupBy("_band").agg(F.sum("group_rows").alias("_all"))
    at = (F.col("_run") - F.col("group_rows") / 2) / F.col("_all")
    choice, edge = F.lit(names[-1]), 1.0
    for n in reversed([n for n in names if open_[n] > 0] or names):
        choice = F.lit(n) if edge == 1.0 else F.when(at < edge, F.lit(n)).otherwise(choice)
        edge -= open_[n] / left
    dealt = run.join(F.broadcast(sums), "_band").select("group_key", choice.alias("split"))
    schema = f"group_key {dict(grouped.dtypes)['group_key']}, split string"
    return cut(dealt.unionByName(spark.createDataFrame(placed, schema)), "dealt")


def assign(df: DataFrame, key: str, base: str, targets: list[tuple[str, float]], row_id: str, seed: int = 17) -> DataFrame:
    """(row_id, key, split) of every row; a row with a null key is a group of its own. An empty table gives an empty one."""
    grouped = groups(ties(df, key, base))
    loose = df.where(F.col(f"`{key}`").isNull()).select(F.concat(F.lit("n"), F.col(f"`{row_id}`").cast("string")).alias("group_key"), F.lit(1).cast("long").alias("group_rows"))
    sizes = cut(grouped.groupBy("group_key").agg(F.first("group_rows").alias("group_rows")).select(F.concat(F.lit("k"), "group_key").alias("group_key"), "group_rows").unionByName(loose), "sizes")
    splits = deal(sizes, targets, seed)
    by_key = cut(grouped.select("key", F.concat(F.lit("k"), "group_key").alias("group_key")).join(splits, "group_key").select("key", "split"), "by_key")
    rows = df.select(F.col(f"`{row_id}`").alias("_row"), F.col(f"`{key}`").alias("key"))
    tied = lookup(rows.where(F.col("key").isNotNull()), by_key, "key").select("_row", "key", "split")
    free = rows.where(F.col("key").isNull()).withColumn("group_key", F.concat(F.lit("n"), F.col("_row").cast("string"))).join(splits, "group_key").select("_row", "key", "split")
    return tied.unionByName(free).select(F.col("_row").alias(row_id), F.col("key").alias(key), "split")
