"""One-to-one matching: greedy within a bounded group, mutual-best rounds elsewhere."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislemetry.session import cut


def greedy_slots(pairs: Column) -> Column:
    """Greedy one-to-one choice from a sorted array of structs with slots i, j < 64.

    A frame record has 64 slots, so one 64-bit mask per side remembers what is
    taken. Returns the kept structs in input order.
    """
    def bit(slot):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.cast("int"))

    kept_type = F.slice(pairs, 1, 0)
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
                     kept_type.alias("kept"))

    def step(acc, p):
        taken = (acc["a"].bitwiseAND(bit(p["i"])) != 0) | (acc["b"].bitwiseAND(bit(p["j"])) != 0)
        return F.when(taken, acc).otherwise(F.struct(
            acc["a"].bitwiseOR(bit(p["i"])).alias("a"), acc["b"].bitwiseOR(bit(p["j"])).alias("b"),
            F.concat(acc["kept"], F.array(p)).alias("kept")))

    return F.aggregate(pairs, start, step)["kept"]


def mutual_best(candidates: DataFrame, left, right, rank) -> DataFrame:
    """Greedy one-to-one matching of a candidate table of any size.

    `rank` columns order all candidates of a key totally. A pair that is the best
    remaining one of both its sides is what the greedy pass would take, so such
    pairs are taken in rounds until no candidate is left. `left` and `right`
    identify the two sides.
    """
    left, right, rank = list(left), list(right), list(rank)
    order = F.struct(*rank)
    rest, taken = cut(candidates), []
    while not rest.isEmpty():
        best_l = rest.groupBy(*left).agg(F.min(order).alias("__bl"))
        best_r = rest.groupBy(*right).agg(F.min(order).alias("__br"))
        won = cut(rest.join(best_l, left).join(best_r, right)
                  .where((order == F.col("__bl")) & (order == F.col("__br")))
                  .drop("__bl", "__br").select(*candidates.columns))
        taken.append(won)
        rest = cut(rest.join(won.select(*left), left, "left_anti")
                   .join(won.select(*right), right, "left_anti").select(*candidates.columns))
    out = candidates.sparkSession.createDataFrame([], candidates.schema)
    for t in taken:
        out = out.unionByName(t)
    return out


def chain_heads(links: DataFrame, keys, node, pred) -> DataFrame:
    """Head and distance of every node that has a predecessor; a node that has none is its own head and is not listed.

    Pointer doubling: each round halves the remaining distance, so the rounds
    grow with the logarithm of the longest chain. Only links take part in them.
    """
    keys = list(keys)
    cur = cut(links.where(F.col(pred).isNotNull()).select(
        *keys, node, F.col(pred).alias("head"), F.lit(1).cast("bigint").alias("dist")))
    while True:
        up = cur.select(*keys, F.col(node).alias("head"), F.col("head").alias("__h"), F.col("dist").alias("__d"))
        nxt = cut(cur.join(up, [*keys, "head"], "left").select(
            *keys, node, F.coalesce("__h", "head").alias("head"),
            (F.col("dist") + F.coalesce("__d", F.lit(0))).alias("dist"), F.col("__h").isNotNull().alias("__moved")))
        moved = not nxt.where("__moved").isEmpty()
        cur = nxt.drop("__moved")
        if not moved:
            return cur
