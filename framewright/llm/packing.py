"""Packing documents into sequences of fixed capacity, balanced by cost.

A document longer than the capacity is cut into pieces of the capacity and a rest; nothing else is split. Full
pieces are sequences of their own. What remains is spread at random over shards of about ``SHARD_TOKENS``
tokens; a shard is packed on its own, so its size, and that of a task, does not grow with the corpus, and only
a shard's last sequences lose room to the split.

Within a shard pieces are taken in falling length. Each goes to the sequence of the lowest cost (a linear plus
a quadratic term, that of attention within documents) that still has room, and opens one if none has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import VOCABULARY, token_counts
from framewright.session import cut

SHARD_TOKENS = 1_000_000
MAX_CONTAINERS = 1000  #: container kinds; more are refused, not dropped
LINEAR_COST = 1.0  #: cost of a token
QUADRATIC_COST = 1.0 / 4096  #: cost of a pair of tokens of one document


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece; ``sizes`` fall and none exceeds ``capacity``."""
    n = len(sizes)
    target = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(max(target, 1) + n, 0, np.int64)
    cost = np.zeros(len(room))
    room[:target] = capacity
    opened = target
    at = np.empty(n, np.int64)
    for i, size in enumerate(sizes):
        free = np.flatnonzero(room[:opened] >= size)
        if len(free):
            k = free[np.argmin(cost[free])]
        else:
            k, opened = opened, opened + 1
            room[k] = capacity
        at[i] = k
        room[k] -= size
        cost[k] += LINEAR_COST * size + QUADRATIC_COST * float(size) * float(size)
    return at


_PLACED = "container_id int, shard int, sequence int, doc_id long, piece_no int, first_token long, n_tokens long"


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    rows["sequence"] = pack(rows["n_tokens"].to_numpy(), int(rows["capacity"].iloc[0])).astype("int32")
    return rows[["container_id", "shard", "sequence", "doc_id", "piece_no", "first_token", "n_tokens"]]


def pack_documents(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container_id, sequence_id, doc_id, piece_no, first_token, n_tokens): where every token of every document lies.

    Each container of ``containers`` (by capacity_tokens; null and non-positive ones are left out) is filled
    with the whole corpus. ``sequence_id`` names one filled container. ``piece_no`` counts a document's pieces
    from 0, ``first_token`` is the place of the piece in the document. Documents without text have no tokens
    and lie nowhere; rows that repeat a ``doc_id`` are packed once (the longest); a null id is left out.
    """
    counts = token_counts(documents.where("doc_id is not null"), path).groupBy("doc_id").agg(F.max("n_tokens").alias("n")).where("n > 0")
    counts = cut(counts)
    sizes = containers.where("capacity_tokens > 0 and container_id is not null").groupBy("container_id").agg(F.max("capacity_tokens").alias("capacity")).orderBy("container_id").take(MAX_CONTAINERS + 1)
    if len(sizes) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers")
    kinds = F.array([F.struct(F.lit(int(c)).alias("container_id"), F.lit(int(n)).cast("long").alias("capacity")) for c, n in sizes]) if sizes else F.expr("cast(array() as array<struct<container_id:int,capacity:bigint>>)")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    pieces = (
        counts.select("doc_id", "n", F.explode(kinds).alias("kind"))
        .select("doc_id", "n", "kind.*")
        .select("container_id", "capacity", "doc_id", "n", F.posexplode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("long"))).alias("piece_no", "p"))
        .select("container_id", "capacity", "doc_id", "piece_no", (F.col("p") * F.col("capacity")).alias("first_token"), F.least(F.col("n") - F.col("p") * F.col("capacity"), "capacity").alias("n_tokens"))
    )
    full = pieces.where("n_tokens = capacity").select("container_id", F.format_string("f-%d-%d", "doc_id", "piece_no").alias("sequence_id"), "doc_id", "piece_no", "first_token", "n_tokens")
    rest = pieces.where("n_tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    packed = rest.groupBy("container_id", "shard").applyInPandas(_pack_shard, _PLACED)
    placed = packed.select("container_id", F.format_string("s-%d-%d", "shard", "sequence").alias("sequence_id"), "doc_id", "piece_no", "first_token", "n_tokens")
    return full.unionByName(placed)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, capacity_tokens, sequences, tokens, fill, packed_sequences, packed_fill, cost_spread): how full the
    sequences are, those that are one full piece of a longer document and those that were packed together and the
    latter alone, and how far their costs lie apart (standard deviation over mean)."""
    cost = F.sum(LINEAR_COST * F.col("n_tokens") + QUADRATIC_COST * F.col("n_tokens") * F.col("n_tokens"))
    each = packed.groupBy("container_id", "sequence_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), cost.alias("cost"))
    sized = each.join(containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens").distinct(), "container_id")
    mixed = (F.col("pieces") > 1) | (F.col("used") < F.col("capacity_tokens"))
    report = sized.groupBy("container_id", "capacity_tokens").agg(
        F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.count_if(mixed).alias("packed_sequences"),
        F.sum(F.when(mixed, F.col("used")).otherwise(0)).alias("_mixed"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )
    full = lambda tokens, n: F.when(F.col(n) > 0, F.col(tokens) / (F.col(n) * F.col("capacity_tokens")))
    return report.select("container_id", "capacity_tokens", "sequences", "tokens", full("tokens", "sequences").alias("fill"), "packed_sequences", full("_mixed", "packed_sequences").alias("packed_fill"), "cost_spread")
