"""Items of varying length packed into containers of fixed capacity: local best fit, then a tree of merges.

Every partition packs its items best fit, longest first, and hands on the
containers that are nearly full. The rest is opened again and meets the rest of
other partitions, in fewer, wider partitions each round, so that the short
items of one fill the gaps of another. An item is divided only if it exceeds
the capacity, and then into full containers and one remainder.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.session import checkpointed

#: Items that a task takes at most, on average, in any round.
TASK_ITEMS = 200_000
#: Partitions that meet in one of the next round.
FAN_IN = 8


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, list[tuple]]]:
    """(free, items) of each container. items: tuples whose first field is the size, none over the capacity.

    Longest first, each into the container with the least room that takes it;
    ties go to the container opened first.
    """
    room: list[tuple[int, int]] = []  # (free, container), ascending
    containers: list[list[tuple]] = []
    free: list[int] = []
    for item in sorted(items, key=lambda x: (-x[0], x[1:])):
        at = bisect_left(room, (item[0], -1))
        if at == len(room):
            k = len(containers)
            containers.append([item])
            free.append(capacity - item[0])
        else:
            _, k = room.pop(at)
            containers[k].append(item)
            free[k] -= item[0]
        if free[k]:
            insort(room, (free[k], k))
    return list(zip(free, containers))


def pack_items(items: DataFrame, specs: DataFrame, near: float = 0.01) -> DataFrame:
    """spec_name, container, item_id, piece, start_token, n_tokens: where every item goes, for each capacity.

    items: item_id, n_tokens. specs: spec_name, capacity_tokens, a table of a
    few rows. A container counts as nearly full with at most the share `near`
    left. Items with null, zero or negative size need no container; a repeated
    item is packed once per repetition (copy counts them). Capacities of null
    or zero take nothing. Rounds go on until a single lane is left, or until
    merging would need as many lanes as before.
    """
    spark = items.sparkSession
    known = sorted({(r["spec_name"], int(r["capacity_tokens"])) for r in specs.where("capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().collect()})
    sized = items.where("n_tokens > 0").select(F.col("item_id").cast("bigint"), F.col("n_tokens").cast("bigint"))

    def divide(rows: Iterable[tuple]) -> Iterator[tuple]:
        for item, n in rows:
            for spec, capacity in known:
                for piece, start in enumerate(range(0, n, capacity)):
                    yield spec, capacity, item, piece, start, min(capacity, n - start)

    schema = "spec_name string, capacity bigint, item_id bigint, piece int, start_token bigint, n_tokens bigint"
    most = max((n or 0 for n in sized.agg(F.lit(0), *(F.sum(F.ceil(F.col("n_tokens") / c)) for _, c in known)).first()), default=0)
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(most) // TASK_ITEMS))
    open_items = map_rows(sized, schema, divide).withColumn("lane", F.pmod(F.xxhash64("item_id", "piece"), F.lit(lanes)).cast("int"))
    # What fills a container alone goes past the rounds.
    closed = [open_items.where("n_tokens = capacity").select("spec_name", F.concat_ws("/", F.lit("full"), "item_id", "piece").alias("container"), "item_id", "piece", "start_token", "n_tokens")]
    open_items = open_items.where("n_tokens < capacity")
    placed = "spec_name string, capacity bigint, container string, item_id bigint, piece int, start_token bigint, n_tokens bigint, lane int, done boolean"
    for turn in count():
        last = lanes == 1

        def pack(rows: Iterable[tuple], turn: int = turn, last: bool = last) -> Iterator[tuple]:
            held: dict[tuple, list[tuple]] = {}
            at = None

            def put() -> Iterator[tuple]:
                for (spec, capacity, lane), own in held.items():
                    for i, (free, inside) in enumerate(best_fit(own, capacity)):
                        name = f"{turn}/{lane}/{i}"
                        for n, item, piece, start in inside:
                            yield spec, capacity, name, item, piece, start, n, lane, last or free <= near * capacity

            for spec, capacity, item, piece, start, n, lane in rows:
                if (spec, capacity, lane) != at:
                    yield from put()
                    held.clear()
                    at = (spec, capacity, lane)
                    held[at] = []
                held[at].append((n, item, piece, start))
            yield from put()

        lined = open_items.select("spec_name", "capacity", "item_id", "piece", "start_token", "n_tokens", "lane")
        packed = checkpointed(map_rows(lined.repartition("spec_name", "lane").sortWithinPartitions("spec_name", "lane"), placed, pack))
        closed.append(packed.where("done").select("spec_name", "container", "item_id", "piece", "start_token", "n_tokens"))
        if last:
            break
        rest = packed.where("not done")
        size = rest.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if not size:
            break
        fewer = max(-(-lanes // FAN_IN), -(-size // TASK_ITEMS))
        if fewer >= lanes:
            closed.append(rest.select("spec_name", "container", "item_id", "piece", "start_token", "n_tokens"))
            break
        lanes = fewer
        open_items = rest.drop("container", "done", "lane").withColumn("lane", F.pmod(F.xxhash64("item_id", "piece", F.lit(turn)), F.lit(lanes)).cast("int"))
    result = closed[0]
    for more in closed[1:]:
        result = result.unionByName(more)
    return result


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, capacity_tokens, n_containers, n_tokens, fill, n_divided, least_containers: how well each capacity is used.

    least_containers is what the tokens would need without any loss.
    """
    containers = packed.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("piece") == 1).cast("bigint")).alias("n_divided"))
    sums = containers.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_divided").alias("n_divided"))
    capacity = F.col("capacity_tokens").cast("bigint")
    return sums.join(F.broadcast(specs.select("spec_name", "capacity_tokens").distinct()), "spec_name").select(
        "spec_name", "capacity_tokens", "n_containers", "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"), "n_divided",
        F.ceil(F.col("n_tokens") / capacity).cast("bigint").alias("least_containers"),
    )
