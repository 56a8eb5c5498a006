"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Target tokens of every source are turned into whole blocks of BLOCK tokens by highest
quotients. A source's documents are dealt by a seeded hash into shards of about
SHARD tokens, and its blocks are apportioned again, by the same rule, first to
groups of shards and then to the shards. In a shard the documents stand in seeded order on one
token line, cut into blocks; every block is taken quota // n times and the seeded
first quota % n of them once more. So a document is taken in whole blocks, at most
EPOCHS times, and no step holds more than one shard, or one source's groups.

Defined results: null or empty text has size 0 and gives nothing; a null source is
a source of its own, after the others; repeated rows are dealt together and each
counts; an empty table gives an empty result. Other columns pass through untouched in
mix(). Per-source totals are taken to the driver: the number of sources, not of
documents, bounds them, and more than MAX_SOURCES raises.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import settle
from .text import mix as scramble

BLOCK = 64
SHARD = 2_000_000
EPOCHS = 2
SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 1_000_000
SEED = 17
ALL_BLOCKS = 1 << 60
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, epochs: float = EPOCHS) -> np.ndarray:
    """Share total by weight; who would exceed epochs * size stops there and the rest is shared again."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    cap, out = epochs * sizes, np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    left = min(float(total), cap.sum())
    while free.any():
        share = left * weights[free] / weights[free].sum()
        at = np.flatnonzero(free)
        over = share > cap[at]
        if not over.any():
            out[at] = share
            break
        out[at[over]] = cap[at[over]]
        left -= cap[at[over]].sum()
        free[at[over]] = False
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier; most: upper limits.

    A divisor found by bisection seats all but a few, and a heap of quotients hands out the rest.
    """
    votes = np.asarray(votes, dtype=float)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, dtype=np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.astype(float).sum()))
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return got
    lo, hi = 0.0, float(votes.max()) * 4  # got at hi is 0; lower divisors seat more
    give = lambda d: np.minimum(most.astype(float), np.floor(votes / d + 0.5))
    d = hi
    for _ in range(200):
        d = (lo + hi) / 2
        if d <= 0 or lo >= hi:
            break
        if give(d).sum() > seats:
            lo = d
        else:
            hi = d
    got = give(hi).astype(np.int64)
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def take(size: np.ndarray, order: np.ndarray, quota: int, block: int, key: int, epochs: int = EPOCHS) -> np.ndarray:
    """Tokens taken of each document of one shard; order: seeded, ties already broken.

    The line is cut into the fewest equal blocks of at most block tokens; the quota's tokens are as many of these as come nearest.
    """
    out = np.zeros(len(size), dtype=np.int64)
    total = int(size.sum())
    n = -(-total // block)
    if not n or quota <= 0:
        return out
    quota = min(epochs * n, (2 * quota * block * n + total) // (2 * total))
    times = np.full(n, quota // n, dtype=np.int64)
    rest = quota % n
    if rest:
        rank = scramble(np.arange(n, dtype=np.uint64) ^ scramble(np.array([key & (2**63 - 1)], np.uint64)))
        times[np.argsort(rank, kind="stable")[:rest]] += 1
    edge = np.arange(n + 1, dtype=np.int64) * total // n
    upto = np.concatenate([[0], np.cumsum(times * np.diff(edge))])
    stop = np.cumsum(size[order])
    start = stop - size[order]

    def before(x: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(edge, x, side="right") - 1, 0, n - 1)
        return upto[k] + times[k] * (x - edge[k])

    out[order] = before(stop) - before(start)
    return out


def apportion(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK, shard_tokens: int = SHARD, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken; one row for each row of docs.

    Weights go to the sources by code point, repeating.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    base = settle(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size, F.xxhash64(F.col(text)).alias("print")))
    found = base.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).toPandas()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser source")
    # UTF-8 bytes sort as code points do; null stands last
    found["by"] = [(s is None, (s or "").encode()) for s in found.source]
    found = found.sort_values("by").reset_index(drop=True)
    sizes = found.source_size.to_numpy(dtype=np.int64)
    w = np.array([weights[i % len(weights)] for i in range(len(found))])
    found["target"] = targets(sizes, w, share * float(sizes.sum()), epochs) if len(found) else np.zeros(0)
    found["n_shards"] = np.maximum(1, -(-sizes // shard_tokens))
    # a source that stops at its cap gives every block in every epoch; the others share the rest of the blocks
    capped = found.target.to_numpy() >= epochs * sizes
    rest = found.target.to_numpy() * ~capped
    shared = sainte_lague(rest, int(round(rest.sum() / block)), epochs * -(-sizes // block)) if len(found) else np.zeros(0, np.int64)
    found["quota"] = np.where(capped, ALL_BLOCKS, shared)
    found["at"] = np.arange(len(found))
    plan = spark.createDataFrame(found[["at", "source", "source_size", "target", "n_shards", "quota"]], "at long, source string, source_size long, target double, n_shards long, quota long")

    roll = F.xxhash64("doc_id", "print", F.lit(seed))  # rows that share an id, or have none, are dealt by their texts
    every = base.join(plan, base.source.eqNullSafe(plan.source)).select("doc_id", "size", "print", "at", "source_size", "target", "n_shards", "quota", F.pmod(roll, F.col("n_shards")).alias("shard"))
    dealt, bare = every.where("size > 0"), every.where("size = 0")  # rows without a word take no part

    shards = dealt.groupBy("at", "shard").agg(F.sum("size").alias("shard_size"), F.first("n_shards").alias("n_shards"), F.first("quota").alias("quota"))
    shards = shards.withColumn("group", (F.col("shard") / F.ceil(F.sqrt("n_shards"))).cast("long"))
    groups = shards.groupBy("at", "group").agg(F.sum("shard_size").alias("votes"), F.sum(F.ceil(F.col("shard_size") / block) * epochs).alias("most"), F.first("quota").alias("quota"))

    def split(key: str):
        def give(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            got = sainte_lague(pdf.votes.to_numpy(), int(pdf.quota.iloc[0]), pdf["most"].to_numpy())
            return pd.DataFrame({"at": pdf["at"], key: pdf[key], "seats": got})

        return give

    by_group = groups.groupBy("at").applyInPandas(split("group"), "at long, group long, seats long")
    inner = shards.drop("quota").join(by_group.withColumnRenamed("seats", "quota"), ["at", "group"]).select("at", "group", "shard", F.col("shard_size").alias("votes"), (F.ceil(F.col("shard_size") / block) * epochs).alias("most"), "quota")
    by_shard = inner.groupBy("at", "group").applyInPandas(split("shard"), "at long, shard long, seats long")

    def pick(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["doc_id", "size", "print"], kind="stable").reset_index(drop=True)
        ids, size = left.doc_id.fillna(-1).to_numpy(dtype=np.int64), left["size"].to_numpy(dtype=np.int64)
        key = (int(keys[0]) * 1_000_003 + int(keys[1])) * 8191 + seed
        order = np.lexsort((np.arange(len(ids)), scramble(ids.astype(np.uint64) ^ np.uint64(key & (2**63 - 1)))))
        quota = int(right.seats.iloc[0]) if len(right) else 0
        left["taken"] = take(size, order, quota, block, key, epochs)
        return left[["doc_id", "size", "source_size", "target", "taken"]]

    picked = dealt.select("doc_id", "size", "print", "source_size", "target", "at", "shard").groupBy("at", "shard").cogroup(by_shard.groupBy("at", "shard")).applyInPandas(pick, "doc_id long, size long, source_size long, target double, taken long")
    return picked.union(bare.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with a column taken: the words of the row that the mix takes. Rows that it leaves out go.

    Rows that share a doc_id are told apart by their sizes; those equal in both are alike to the mix.
    The join always shuffles, so that its cost is in proportion to the input at every size.
    """
    text, doc_id = how.get("text", "text"), how.get("doc_id", "doc_id")
    counts = apportion(docs, **how)
    counts = counts.select(F.col("doc_id").alias("_d"), "taken", F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "taken")).alias("_j")).where("taken > 0")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "taken"]).alias("_row")  # so that no name of docs meets one of ours
    own = docs.select(whole, F.col(doc_id).cast("long").alias("_c"), size.alias("_s"))
    own = own.select("_row", "_c", F.row_number().over(Window.partitionBy("_c").orderBy("_s")).alias("_i"))
    return own.join(counts.hint("merge"), F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_i") == F.col("_j"))).select("_row.*", "taken")
