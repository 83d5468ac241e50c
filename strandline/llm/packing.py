"""Texts into containers of one capacity: a linear grouping scheme.

Sizes are whole tokens, so all that the plan needs is a histogram of at most ``capacity`` sizes.  Large sizes are
ranked, cut into groups of equal cardinality and rounded up to their group's largest; the few rounded sizes make a
configuration programme (columns generated by a knapsack, Gilmore and Gomory), whose whole part and a first-fit rest
say which sizes share a container.  Actual documents take the slots by rank arithmetic, without a sequential pass.
Small documents then go, best fit, into the room that is left, in shards of bounded size.

Only a text longer than the capacity is cut: into full pieces, which fill a container each, and a rest.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import durable

CAPACITY = 2048
SMALL = 1 / 8  #: sizes up to this share of the capacity are small
GROUPS = 24
SHARD_ROWS = 200_000  #: containers and small documents of a shard, about
RANK_ROWS = 500_000  #: rows of one size that are ranked together, about


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_defaults() -> tuple[str, str]:
    """(path of the public byte-level vocabulary, its pattern)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _token_counts(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(os.path.basename(path))
        encode = _encoder(sent if os.path.exists(sent) else path, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encode(t)) for t in pdf["text"]]})

    return run


def token_sizes(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every text that is not NULL.

    ``vocabulary`` is the path of a byte-level vocabulary on the driver, which is sent to the executors; without path
    and pattern those of the installed public tokenizers count.
    """
    path, pat = (vocabulary, pattern) if vocabulary and pattern else tokenizer_defaults()
    vocabulary, pattern = vocabulary or path, pattern or pat
    documents.sparkSession.sparkContext.addFile(vocabulary)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    return docs.mapInPandas(_token_counts(vocabulary, pattern), "doc_id bigint, tokens bigint")


# ---------------------------------------------------------------- the plan: a few sizes, on the driver


def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of sizes of the greatest total value within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(size.min()), capacity + 1):
        k = np.flatnonzero(size <= c)
        v = best[c - size[k]] + value[k]
        j = int(v.argmax())
        best[c] = best[c - 1]
        if v[j] > best[c] + 1e-12:
            best[c], pick[c] = v[j], k[j]
    out, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= size[pick[c]]
    return out


def configurations(size: np.ndarray, count: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """[(counts of each size, containers)] that hold ``count`` items of each size: near the fewest containers."""
    k = len(size)
    if not k:
        return []
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        new = best_pattern(np.maximum(dual, 0), size, capacity)
        if dual @ new <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, count.astype(float)), np.linalg.solve(basis, new.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / step, np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = new
    left = count.astype(np.int64).copy()
    out = []
    for p, x in sorted(zip(basis.T.round().astype(np.int64), np.linalg.solve(basis, count.astype(float))), key=lambda z: -z[1]):
        used = p > 0
        n = int(min(np.floor(max(x, 0) + 1e-9), (left[used] // p[used]).min() if used.any() else 0))
        if n > 0:
            out.append((p, n))
            left -= n * p
    while left.any():  # the rest: first fit, largest first, whole containers at a time
        p, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-size):
            n = min(int(left[i]), room // int(size[i]))
            p[i], room = n, room - n * int(size[i])
        used = p > 0
        n = max(1, int((left[used] // p[used]).min()))
        out.append((p, n))
        left -= n * p
    return out


class Plan:
    """Where each rank of the large items goes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, capacity: int, small: float = SMALL, groups: int = GROUPS):
        order = np.argsort(-sizes)
        sizes, counts = sizes[order], counts[order]
        self.capacity, self.limit = capacity, int(capacity * small)
        large = sizes > self.limit
        self.n_large = int(counts[large].sum())
        self.n_full = int(counts[sizes == capacity].sum())  # these ranks come first, a container each
        ranks = self.n_large - self.n_full
        per = -(-ranks // groups) if ranks else 1
        self.per = per
        k = -(-ranks // per) if ranks else 0
        ends = np.cumsum(counts[large])
        starts = self.n_full + per * np.arange(k)
        size = sizes[large][np.searchsorted(ends, starts, side="right")] if k else np.empty(0, np.int64)
        number = np.minimum(per, ranks - per * np.arange(k))
        # groups of one rounded size share their patterns
        which, self.group_size = (np.unique(size, return_inverse=True)[::-1]) if k else (np.empty(0, int), size)
        self.size_of_group = which
        total = np.bincount(which, weights=number, minlength=len(self.group_size)).astype(np.int64)
        self.before = np.zeros(k, np.int64)  # ranks of the same size in earlier groups
        seen = np.zeros(len(self.group_size), np.int64)
        for g in range(k):
            self.before[g] = seen[which[g]]
            seen[which[g]] += number[g]
        found = configurations(self.group_size, total, capacity)
        base = self.n_full
        slots: list[list[tuple[int, int, int]]] = [[] for _ in self.group_size]
        filled = np.zeros(len(self.group_size), np.int64)
        for pattern, n in found:
            for s in np.flatnonzero(pattern):
                slots[s].append((int(filled[s]), base, int(pattern[s])))
                filled[s] += n * pattern[s]
            base += n
        self.slots = [tuple(np.asarray(c, np.int64) for c in zip(*s)) for s in slots]
        self.containers = base

    def container(self, rank: np.ndarray) -> np.ndarray:
        """The container of each large rank."""
        out = rank.astype(np.int64).copy()
        rest = np.flatnonzero(rank >= self.n_full)
        r = rank[rest] - self.n_full
        group = r // self.per
        slot = self.before[group] + r - group * self.per
        which = self.size_of_group[group]
        for s in np.unique(which):
            m = which == s
            first, base, each = self.slots[s]
            j = np.searchsorted(first, slot[m], side="right") - 1
            out[rest[m]] = base[j] + (slot[m] - first[j]) // each[j]
        return out


# ---------------------------------------------------------------- small items, best fit


def _best_fit(capacity: int, first_new: int, shards: int):
    """mapInPandas body over rows sorted by shard, containers first, then small items by size, largest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, opened, mask = None, 0, 0
        room: list[list[int]] = []
        for pdf in batches:
            out = []
            for i, (sh, is_item, size, container) in enumerate(zip(*(pdf[c].tolist() for c in ("shard", "is_item", "size", "container")))):
                if sh != shard:
                    shard, opened, mask = sh, 0, 0
                    room = [[] for _ in range(capacity + 1)]
                if not is_item:
                    free = capacity - size
                    room[free].append(container)
                    mask |= 1 << free
                    continue
                fits = mask >> size
                if fits:
                    free = size + (fits & -fits).bit_length() - 1
                    at = room[free].pop()
                    if not room[free]:
                        mask ^= 1 << free
                else:
                    free, at = capacity, first_new + sh + shards * opened
                    opened += 1
                room[free - size].append(at)
                mask |= 1 << (free - size)
                out.append((i, at))
            if out:
                rows, at = zip(*out)
                got = pdf.iloc[list(rows)]
                yield pd.DataFrame({"doc_id": got["doc_id"], "piece": got["piece"], "start": got["start"], "tokens": got["size"], "container": np.asarray(at, np.int64)})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, tokens, container): every item of ``sizes`` (doc_id, tokens) in a container.

    ``piece`` counts from 0 and ``start`` is its first token; only items above ``capacity`` have several pieces.
    Items of no tokens take no room but have a container.  NULL sizes are left out; rows that repeat a doc_id are
    items of their own.  Empty input gives no row.
    """
    spark = sizes.sparkSession
    cut = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    items = sizes.where("tokens is not null and tokens >= 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), cut)).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * capacity).alias("size"))
    items = durable(items)
    hist = items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().set_index("size")["n"].sort_index()  # capacity + 1 rows at most
    total = int(hist.sum())
    # a size is ranked in as many parts as its own documents ask for
    parts = {int(s): int(-(-n // RANK_ROWS)) for s, n in hist.items() if n > RANK_ROWS}
    split = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else None
    salts = F.coalesce(F.try_element_at(split, F.col("size").cast("int")), F.lit(1)) if parts else F.lit(1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    table = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()  # capacity + 1 + total / RANK_ROWS rows, about
    table = table.sort_values(["size", "salt"], ascending=[False, True])
    table["before"] = table["n"].cumsum() - table["n"]
    plan = Plan(hist.index.to_numpy(np.int64), hist.to_numpy(np.int64), capacity, small, groups)
    limit = plan.limit
    offsets = spark.createDataFrame(table[["size", "salt", "before"]].astype({"size": "int64", "salt": "int32", "before": "int64"}), "size bigint, salt int, before bigint")
    large = salted.where(F.col("size") > limit).join(F.broadcast(offsets), ["size", "salt"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "tokens": pdf["size"], "container": shared.value.container(pdf["rank"].to_numpy(np.int64))})

    schema = "doc_id bigint, piece int, start bigint, tokens bigint, container bigint"
    placed = durable(large.select("doc_id", "piece", "start", "size", rank.alias("rank")).mapInPandas(place, schema))
    n_small = total - plan.n_large
    shards = max(1, (plan.containers - plan.n_full + n_small) // SHARD_ROWS)
    used = placed.groupBy("container").agg(F.sum("tokens").alias("size")).where(F.col("size") < capacity)
    none = F.lit(None)
    open_rows = used.select(F.pmod(F.xxhash64("container"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_item"), "size", "container", none.cast("bigint").alias("doc_id"), none.cast("int").alias("piece"), none.cast("bigint").alias("start"))
    small_rows = items.where(F.col("size") <= limit).select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("is_item"), "size", none.cast("bigint").alias("container"), "doc_id", "piece", "start")
    rows = open_rows.unionByName(small_rows).repartition(F.col("shard")).sortWithinPartitions("shard", "is_item", F.desc("size"), "doc_id", "piece", "container")
    filled = rows.mapInPandas(_best_fit(capacity, plan.containers, shards), schema)
    return placed.unionByName(filled)
