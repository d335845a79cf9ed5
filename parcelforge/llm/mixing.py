"""Sources mixed to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.engine import cut
from parcelforge.operators.ordered import running_total

STARVED = 0.1  # a source that can't keep its share of even this part of one pass over all sources doesn't set the budget


def plan(stats: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], budget: int | None = None, starved: float = STARVED) -> list[dict]:
    """What each target source may give: share, docs, tokens, cap on tokens, quota; from (docs, tokens) per source.

    The shares of sources with tokens are scaled to 1. Without a budget, it is the largest total at which every source
    still reaches its share with its repeats; a source whose repeated tokens fall short of its share of `starved` times
    one pass is left out of that rule (0 leaves out none). It gives all it has, and the report names it (`starved`) with its shortfall. With a budget beyond
    what the sources can give in their shares, those that run dry drop out of the queue and the others share the rest.
    A null or non-positive share means the source isn't used; a null max_repeats is 1.
    """
    rows = []
    for source, share, repeats in targets:
        share = share if share is not None and math.isfinite(share) and share > 0 else 0.0
        docs, tokens = stats.get(source, (0, 0))
        repeats = 1 if repeats is None else max(0, repeats)
        rows.append({"source": source, "target_share": share, "max_repeats": repeats, "docs": docs, "source_tokens": tokens, "cap": tokens * repeats})
        rows[-1]["starved"] = False
    fed = [r for r in rows if r["target_share"] > 0 and r["cap"] > 0]
    whole = sum(r["target_share"] for r in fed)
    for r in rows:
        r["weight"] = r["target_share"] / whole if r in fed else 0.0
    if budget is None:
        one_pass = sum(r["source_tokens"] for r in fed)
        for r in fed:
            r["starved"] = r["cap"] / r["weight"] < starved * one_pass
        able = [r["cap"] / r["weight"] for r in fed if not r["starved"]]
        budget = int(min(able)) if able else sum(r["cap"] for r in fed)
    # The virtual time at which the queue has sent the budget: sources run dry one after another.
    sent, now, queue = 0.0, 0.0, sorted(fed, key=lambda r: r["cap"] / r["weight"])
    while queue:
        rate = sum(r["weight"] for r in queue)
        dry = queue[0]["cap"] / queue[0]["weight"]
        if sent + rate * (dry - now) >= budget:
            now += (budget - sent) / rate
            break
        sent, now = sent + rate * (dry - now), dry
        queue.pop(0)
    for r in rows:
        r["budget"], r["end"] = int(budget), now
        r["quota"] = min(r["cap"], r["weight"] * now)
    return rows


def mix(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens_col: str, budget: int | None = None, seed: int = 23) -> tuple[DataFrame, list[dict]]:
    """The mixed corpus: (id, source, repeat, tokens, finish, place), and the plan behind it.

    docs is one row per document with its size. Each source's documents are shuffled (by a hash, repeatable) and get
    a running total of tokens, over ranges that no source's size can crowd. The r-th copy of a document finishes at
    (r * tokens of the source + its running total) / weight in virtual time; what finishes by the end the plan computes is
    range-sorted by finish and cut where the running total passes the budget. Only copies that can fall below
    the end are made. Documents without source or of an unlisted one aren't used; a text of no tokens takes no room. targets is
    (source, target_share, max_repeats), a small fixed table.
    """
    wanted = [tuple(r) for r in targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect()]
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("tokens"))
    base = base.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    stats = {r["source"]: (r["docs"], r["tokens"] or 0) for r in base.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    made = plan(stats, wanted, budget)
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["source"], r["weight"], r["source_tokens"], r["max_repeats"], float(r["end"])) for r in made if r["weight"] > 0], "source string, weight double, all_tokens long, max_repeats int, end double")
    run = running_total(base.join(F.broadcast(rates.select("source")), "source", "left_semi"), [F.xxhash64("id", F.lit(seed)), F.col("id")], F.col("tokens"), "run", within=["source"], label="mix")
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("end") * F.col("weight") / F.col("all_tokens")).cast("int") + 1)
    copies = run.join(F.broadcast(rates), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    copies = copies.withColumn("finish", ((F.col("repeat") - 1) * F.col("all_tokens") + F.col("run")) / F.col("weight")).where(F.col("finish") <= F.col("end") * (1 + 1e-12))
    queue = running_total(copies.select("id", "source", "repeat", "tokens", "finish"), [F.col("finish"), F.col("source"), F.col("repeat"), F.xxhash64("id", F.lit(seed)), F.col("id")], F.col("tokens"), "sent", rank="place", label="queue")
    limit = made[0]["budget"] if made else 0
    return queue.where(F.col("sent") <= limit).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "repeat", "tokens", "finish", "place"), made


def shares(mixed: DataFrame, made: list[dict], id_col: str, source_col: str) -> DataFrame:
    """Per target source: target and reached share, tokens and documents used, most uses of one document, whether the source was too small to set the budget, and what is missing to the target."""
    spark = mixed.sparkSession
    want = spark.createDataFrame(
        [(r["source"], r["target_share"], r["max_repeats"], r["docs"], r["source_tokens"], r["starved"]) for r in made], "source string, target_share double, max_repeats int, docs long, source_tokens long, starved boolean"
    )
    per_doc = mixed.groupBy(F.col(source_col).alias("source"), F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("t"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("mixed_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("uses").alias("most_uses"))
    got = cut(got, "got")
    total = got.agg(F.sum("mixed_tokens").alias("_total"))
    out = want.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(total)).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("mixed_tokens", "docs_used", "most_uses")}
    )  # the total is one row
    reached = F.when(F.col("_total") > 0, F.col("mixed_tokens") / F.col("_total")).otherwise(F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "docs", "source_tokens", "mixed_tokens", "docs_used", "most_uses", "starved", reached.alias("reached_share"), (F.col("target_share") - reached).alias("shortfall"))
