"""Problem 8: filling fixed-capacity containers with items.

Method. Items are dealt by a hash of their id into buckets of a bounded number of items and tokens. In each bucket the
number of windows starts at the least possible one, and Karmarkar-Karp differencing splits the items into that many
windows: every item is a partial partition, and again and again the two partial partitions with the largest imbalance
are merged so that their imbalances oppose each other (largest window with smallest). If the fullest window exceeds the
capacity, the number of windows rises and the bucket is differenced again.

An item over the capacity is cut into full windows and a rest; only such items are cut. Defined results: items of
no tokens (null and empty texts) get one row without container; negative or null sizes count as none; repeated rows
are items of their own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import staged

CAPACITY = 2_048
#: Windows and items that a bucket holds on average; they bound the memory of a task and the waste of at most
#: one window a bucket.
BUCKET_WINDOWS, BUCKET_ITEMS = 400, 6_000


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing: the window of each item, and the windows' sums."""
    n = len(sizes)
    left = np.full(2 * n + windows * 2, -1, np.int64)
    right = left.copy()
    used = n
    heap = []
    for i in range(n):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-int(sizes[i]), i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        b, nb = b[::-1], nb[::-1]
        sums, nodes = a + b, np.where(na < 0, nb, na)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            new = np.arange(used, used + len(both))
            if used + len(both) > len(left):
                left, right = (np.concatenate([x, np.full(len(x), -1, np.int64)]) for x in (left, right))
            left[new], right[new], nodes[both] = na[both], nb[both], new
            used += len(both)
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, nodes))
        order += 1
    _, _, sums, nodes = heap[0]
    window = np.full(used, -1, np.int64)
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for x in range(used - 1, n - 1, -1):
        window[left[x]] = window[right[x]] = window[x]
    return window[:n], sums


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item so that none exceeds the capacity; sizes are within it."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, windows)
        over = np.maximum(sums - capacity, 0).sum()
        if not over:
            return window
        windows += max(1, -(-int(over) // capacity))


def fill_containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``container_id, id, piece_no, token_start, n_tokens`` for all items of a (small, staged) table of sizes."""
    kind = sizes.schema[id_col].dataType.simpleString()
    known = sizes.select(F.col(id_col), F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("_n"))
    rest = F.col("_n") % capacity
    total, items = known.agg(F.coalesce(F.sum(rest), F.lit(0)), F.count(F.when(rest > 0, 1))).first()
    buckets = max(1, round(total / (capacity * BUCKET_WINDOWS)), round(items / BUCKET_ITEMS))

    none = known.where("_n = 0").select(F.lit(None).cast("string").alias("container_id"), id_col, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("n_tokens"))
    full = known.where(F.col("_n") >= capacity).select(id_col, F.explode(F.sequence(F.lit(0), (F.floor(F.col("_n") / capacity) - 1).cast("int"))).alias("piece_no"))
    full = full.select(
        F.concat(F.lit("full-"), F.col(id_col).cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"),
        id_col, "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens"),
    )
    loose = known.where(rest > 0).select(
        F.pmod(F.xxhash64(F.col(id_col), F.lit(8)), F.lit(buckets)).alias("_bucket"),
        id_col, F.floor(F.col("_n") / capacity).cast("int").alias("piece_no"), (F.col("_n") - rest).alias("token_start"), rest.alias("n_tokens"),
    )

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([id_col, "piece_no"], kind="stable")
        window = pack(f["n_tokens"].to_numpy(), capacity)
        f.insert(0, "container_id", [f"mixed-{key[0]}-{w}" for w in window])
        return f[["container_id", id_col, "piece_no", "token_start", "n_tokens"]]

    schema = f"container_id string, `{id_col}` {kind}, piece_no int, token_start bigint, n_tokens bigint"
    # Buckets are small but cost time, so they are spread over all cores whatever their size in bytes.
    spread = min(buckets, 3 * sizes.sparkSession.sparkContext.defaultParallelism)
    mixed = loose.repartition(spread, F.col("_bucket")).groupBy("_bucket").applyInPandas(one, schema)
    return none.unionByName(full).unionByName(mixed)


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **vocabulary: str) -> DataFrame:
    """Count the tokens of all texts once (staged: an id and a number a row), then fill the containers."""
    from folioscope.llm.tokenizer import count_tokens

    return fill_containers(staged(count_tokens(df, id_col, text_col, **vocabulary)), id_col, "n_tokens", capacity)


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a container: pieces, tokens used and left."""
    return (
        packed.where("container_id IS NOT NULL")
        .groupBy("container_id")
        .agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )
