"""The N best items of every group, by a multiway merge of sorted runs with a loser tree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.operators.skew import with_salt

HOT_GROUP = 50_000


class LoserTree:
    """Which of k sources has the smallest head: the winner in constant time, the next one in log2(k) comparisons.

    heads[i] is the key at the head of source i, or None once it is exhausted.
    """

    def __init__(self, heads: list):
        self.heads = heads
        self.k = len(heads)
        self.losers = [-1] * max(self.k, 1)
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, source: int) -> None:
        at = (source + self.k) // 2
        while at:
            held = self.losers[at]
            if held < 0:  # while the tree is built: the first to come waits for its opponent
                self.losers[at] = source
                return
            if self._beats(held, source):
                self.losers[at], source = source, held
            at //= 2
        self.winner = source

    def replace(self, key) -> None:
        """A new head for the winner's source."""
        self.heads[self.winner] = key
        self._play(self.winner)


def merge_top(groups: list, keys: list, starts: list[int], ends: list[int], n: int):
    """Yields (row, place) of the n smallest keys of each group, over runs that are each sorted by (group, key).

    Run i is the rows starts[i]:ends[i]. After n outputs of a group, every run whose head is still in it seeks to its
    next group: rows in between are never compared.
    """
    size = len(groups)
    seek = [size] * size  # the first row of the next group in the same run
    for s, e in zip(starts, ends):
        to = e
        for i in range(e - 1, s - 1, -1):
            if i + 1 < e and groups[i + 1] != groups[i]:
                to = i + 1
            seek[i] = to
    at = list(starts)
    tree = LoserTree([(groups[s], keys[s]) if s < e else None for s, e in zip(starts, ends)])
    group, count = None, 0
    while tree.k and (head := tree.heads[tree.winner]) is not None:
        run = tree.winner
        i = at[run]
        if count == 0 or head[0] != group:
            group, count = head[0], 0
        if count < n:
            count += 1
            yield i, count
            i += 1
        if count >= n and i < ends[run] and groups[i] == group:
            i = seek[i]
        at[run] = i
        tree.replace((groups[i], keys[i]) if i < ends[run] else None)


def top_per_group(df: DataFrame, group: str, item: str, score: str, tie: str, latest: list[str], n: int, hot: int = HOT_GROUP) -> DataFrame:
    """(group, item, place, score, tie) of the n best items of each group; place counts from 1.

    Of several rows with the same group and item only the one with the greatest `latest` columns counts (nulls are
    smallest). Then rows with a null, NaN or infinite score go; higher score first, then lower tie (null last), then
    item in string order (null last): a total order. Rows with a null group are in no group.

    1. One shuffle: rows are dealt by group; a hot group (counted first; boundedly many) into parts by a hash of its
       items, so equal items still meet. Each partition keeps the counting row per item and sorts by (group, score,
       tie, item): a sorted run. From each run only n rows per group go on.
    2. The short runs are bucketed by group, and each bucket's runs merged by a loser tree that seeks to the next group
       after n outputs. A hot group brings n rows per part, so no bucket grows with a group.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = df.select(
        F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{tie}`").cast("double").alias("t"),
        F.struct(*[F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(latest)]).alias("l"),
    ).where(F.col("g").isNotNull())
    dealt = with_salt(cols, ["g"], F.xxhash64("i"), hot).repartition("g", "_salt")
    counting = dealt.groupBy("g", "_salt", "i").agg(F.max_by(F.struct("s", "t"), "l").alias("v")).select("g", "i", "v.s", "v.t")
    counting = counting.where(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < F.lit(math.inf)))
    order = [F.col("s").desc(), F.col("t").asc_nulls_last(), F.col("i").asc_nulls_last()]
    runs = counting.sortWithinPartitions(F.col("g"), *order).withColumn("r", F.spark_partition_id())
    layout = "g string, i string, s double, t double, r int"

    def heads(batches):
        import numpy as np
        import pyarrow as pa

        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            codes = g.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1]
            place = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
            lead = int(first[1]) if len(first) > 1 else len(codes)
            if g[0].as_py() == last:
                place[:lead] += seen  # the group goes on from the batch before
            last, seen = g[len(codes) - 1].as_py(), int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    short = runs.mapInArrow(heads, layout).repartition("g").sortWithinPartitions("r", "g", *order)

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("g", pa.string()), ("i", pa.string()), ("s", pa.float64()), ("t", pa.float64()), ("r", pa.int32())]))])
        if not held.num_rows:
            return
        g, items, s, t = (held.column(c).to_pylist() for c in ("g", "i", "s", "t"))
        r = held.column("r").to_numpy()
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(g)]
        keys = [(-x, math.inf if y is None else y, z is None, z or "") for x, y, z in zip(s, t, items)]
        rows = list(merge_top(g, keys, cuts[:-1], cuts[1:], n))
        taken = held.take(pa.array([i for i, _ in rows], pa.int64())).combine_chunks()
        yield pa.RecordBatch.from_arrays([taken.column(c).combine_chunks() if hasattr(taken.column(c), "combine_chunks") else taken.column(c) for c in ("g", "i", "s", "t")] + [pa.array([p for _, p in rows], pa.int32())], ["g", "i", "s", "t", "place"])

    best = short.mapInArrow(merge, "g string, i string, s double, t double, place int")
    return best.select(F.col("g").alias(group), F.col("i").alias(item), "place", F.col("s").alias(score), F.col("t").cast(fields.get(tie, T.DoubleType())).alias(tie))
