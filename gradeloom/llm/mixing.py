"""Records of several sources combined so that each has its share of the tokens, within its allowed repeats.

The size of a mix is the largest at which every source can give its share. It
is cut into equal blocks, which Sainte-Laguë's method hands to the sources, one
by one, by the highest quotient share / (2 k + 1); a source hands its blocks on
to its shards in the same way, by the tokens they hold. What a shard can't
give, because its quota was rounded up beyond its allowed repeats, the next
shards with room take over, so no token of the plan is lost. In a shard,
records come in a seeded order, as often as their quota needs.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import checkpointed

#: Records of a shard, on average, and the most shards of a source: larger sources have larger shards, so that what the driver plans with has a bound.
SHARD_RECORDS, MOST_SHARDS = 20_000, 4_096
#: Blocks of a mix for each shard of it, and the least.
SHARD_BLOCKS, LEAST_BLOCKS = 1_000, 100_000


def sainte_lague(weights: dict[str, float], seats: int) -> dict[str, int]:
    """How many of `seats` each key gets; ties go to the first key in order. Keys without a positive weight get none.

    The seats above a quotient that too few reach are given at once; a heap
    hands out the rest by the highest quotient.
    """
    given = dict.fromkeys(sorted(weights), 0)
    positive = [k for k in given if weights[k] and weights[k] > 0]
    if not positive or seats <= 0:
        return given
    w = np.array([float(weights[k]) for k in positive])
    # A key has as many quotients over t as there are k with w / (2 k + 1) > t.
    over = lambda t: np.floor((w / t + 1) / 2)
    low, high = w.sum() / (2 * seats), w.sum() / seats * (len(w) + 1)
    while over(high).sum() > seats:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle).sum() <= seats else (middle, high)
    # One less of each keeps rounding from giving a seat away out of turn.
    counts = np.maximum(over(high) - 1, 0).astype(int)
    heap = [(-x / (2 * n + 1), i) for i, (x, n) in enumerate(zip(w.tolist(), counts.tolist()))]
    heapq.heapify(heap)
    for _ in range(seats - int(counts.sum())):
        _, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * int(counts[i]) + 1), i))
    return given | {k: int(n) for k, n in zip(positive, counts)}


def shard_quotas(held: dict[str, int], tokens: int, most: int, blocks: int) -> dict[str, int]:
    """Tokens that each shard gives of `tokens`, none more than `most` times what it holds; they sum up to `tokens` as far as all shards hold as much."""
    seats = sainte_lague(held, blocks)
    quotas: dict[str, int] = {}
    owed = start = 0
    for k, n in held.items():
        # Block borders are rounded once, so that the blocks sum up to the tokens.
        end = start + seats[k]
        wanted = tokens * end // blocks - tokens * start // blocks
        start = end
        quotas[k] = min(wanted, most * n)
        owed += wanted - quotas[k]
    for k, n in held.items():
        more = min(owed, most * n - quotas[k])
        quotas[k] += more
        owed -= more
    return quotas


def plan_mixes(held: dict[tuple[str, int], int], targets: list[tuple]) -> list[tuple]:
    """(mix, source, shard, passes, rest): whole passes over a shard and the tokens of a further one.

    held: tokens by (source, shard). targets: (mix, source, share, most
    repeats). Sources without tokens or with a null share or repeats give
    nothing, and the others keep their proportions among the rest.
    """
    shards: dict[str, dict[str, int]] = {}
    for (source, k), n in sorted(held.items()):
        if n:
            shards.setdefault(source, {})[f"{k:09d}"] = n
    plan: list[tuple] = []
    for mix in sorted({t[0] for t in targets}):
        own = {s: (share, int(most)) for m, s, share, most in targets if m == mix and share and share > 0 and most and most > 0 and s in shards}
        if not own:
            continue
        whole = sum(share for share, _ in own.values())
        size = int(min(sum(shards[s].values()) * most * whole / share for s, (share, most) in own.items()))
        blocks = max(LEAST_BLOCKS, SHARD_BLOCKS * sum(len(shards[s]) for s in own))
        for source, seats in sainte_lague({s: share for s, (share, _) in own.items()}, blocks).items():
            if seats:
                for k, tokens in shard_quotas(shards[source], size * seats // blocks, own[source][1], seats).items():
                    if tokens:
                        plan.append((mix, source, int(k), *divmod(tokens, shards[source][k])))
    return plan


def mix_sources(records: DataFrame, targets: DataFrame, seed: int = 20_24) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, repeats: how often each record comes in each mix; records left out have no row.

    records: doc_id, source, n_tokens. targets: mix_name, source, target_share,
    max_repeats, a table of a few rows. Records without tokens or source are
    left out. A record belongs to a shard by the hash of its id; the driver
    holds a row per shard, at most MOST_SHARDS for each source of the targets.
    Repeated rows of a doc_id are records of their own.
    """
    spark = records.sparkSession
    wanted = [tuple(r) for r in targets.select("mix_name", "source", "target_share", "max_repeats").distinct().collect()]
    named = F.broadcast(targets.select("source").where("source is not null").distinct())
    usable = records.where("n_tokens > 0").select(F.col("doc_id").cast("bigint"), "source", F.col("n_tokens").cast("bigint")).join(named, "source")
    # A row for each source of the targets.
    counts = F.broadcast(usable.groupBy("source").agg(F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SHARD_RECORDS))).cast("bigint").alias("n_shards")))
    sharded = checkpointed(usable.join(counts, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("n_shards")).cast("int")).drop("n_shards"))
    held = {(r["source"], r["shard"]): r["n"] for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()}
    planned = spark.createDataFrame(plan_mixes(held, wanted), "mix_name string, source string, shard int, passes bigint, rest bigint")
    order: list[Column] = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("n_tokens")]
    in_order = Window.partitionBy("source", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lined = sharded.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_order), F.lit(0)))
    # A record belongs to the last, partial pass if its middle lies within it.
    chosen = lined.join(planned, ["source", "shard"]).withColumn("repeats", F.col("passes") + (F.col("before") * 2 + F.col("n_tokens") <= F.col("rest") * 2).cast("bigint"))
    return chosen.where("repeats > 0").select("mix_name", "doc_id", "source", "n_tokens", "repeats")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, n_records, most_repeats, n_tokens, actual_share: what each mix really holds."""
    sums = mixed.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens")
    )
    whole = Window.partitionBy("mix_name")
    joined = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().join(sums, ["mix_name", "source"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_records", "most_repeats", "n_tokens")})
    return filled.withColumn("actual_share", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(whole)), F.lit(0.0)))
