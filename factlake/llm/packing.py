"""Problem 6: filling containers of fixed capacity with documents.

Bound-certified repacking. Documents are spread over packing partitions of bounded size, each partition
is packed by best-fit decreasing, and dual-feasible functions give a lower bound of the bins that
the partition's documents need. A partition that meets its bound is certified and done; the
documents of the others' poorly filled bins are exchanged between partitions and packed
again, as long as that saves a bin. The result tells which containers are certified: those of partitions that meet their bound, and full ones. A document that exceeds the capacity is split into full containers and a rest,
none other is split.

Sizes are tokens of a public byte-level BPE; the folder of the vocabulary is a parameter.

Defined results: null and empty texts have no tokens and take no room, they come out in no container; equal
documents are packed each; ties go by document id; a capacity of null or below one is refused.
"""

from __future__ import annotations

import base64
import math
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.common import spread, written

TOKENIZERS = os.environ.get("FACTLAKE_TOKENIZERS", "/opt/tokenizers")
PIECES_A_PARTITION = 20_000
PACKED = "container_kind string, part int, bin int, doc_id long, piece int, tokens int, bound int, bins int"


@lru_cache(maxsize=2)
def _encoding(folder: str):
    import tiktoken

    path = f"{folder}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the pattern of this vocabulary.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens) of every row with text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(folder)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) for t in texts], dtype="int32")

    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("text")).where("text is not null and text <> ''"))
    return rows.select(key, count("text").alias("tokens"))


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that the sizes need at least: the best of the dual-feasible functions that round up above C - e and drop below e, and of the staircase functions."""
    best = math.ceil(sum(sizes) / capacity)
    ordered = sorted(sizes)
    prefix = [0]
    for s in ordered:
        prefix.append(prefix[-1] + s)
    n = len(ordered)
    below = sorted({s for s in ordered if s <= capacity // 2})
    for e in below:
        big = n - bisect_left(ordered, capacity - e + 1)
        middle = prefix[n - big] - prefix[bisect_left(ordered, e)]
        best = max(best, big + math.ceil(middle / capacity))
    for k in range(2, 12):
        # u_k(x) = x where (k + 1) x / C is whole, else floor((k + 1) x / C) C / k, in units of C / k
        total = sum(s * k / capacity if s * (k + 1) % capacity == 0 else s * (k + 1) // capacity for s in ordered)
        best = max(best, math.ceil(total / k - 1e-9))
    return best


def best_fit_decreasing(items: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (tokens, doc_id, piece): each item, largest first, goes into the fullest bin with room."""
    bins: list[list[tuple[int, int, int]]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ordered
    for item in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        k = bisect_left(room, (item[0], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(item)
            left -= item[0]
        else:
            b, left = len(bins), capacity - item[0]
            bins.append([item])
        if left:
            insort(room, (left, b))
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, kind, part = int(pdf["capacity"].iloc[0]), pdf["container_kind"].iloc[0], int(pdf["part"].iloc[0])
    items = list(zip(pdf["tokens"].tolist(), pdf["doc_id"].tolist(), pdf["piece"].tolist()))
    bins = best_fit_decreasing(items, capacity)
    bound = lower_bound([t for t, _, _ in items], capacity)
    rows = [(kind, part, b, d, p, t, bound, len(bins)) for b, bin_ in enumerate(bins) for t, d, p in bin_]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


def _pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row per piece and container kind. capacities is a fixed small table; its rows are joined as an array of each document."""
    kinds = [(r[0], r[1]) for r in capacities.select("container_kind", "capacity_tokens").distinct().collect()]
    if any(c is None or c < 1 for _, c in kinds):
        raise ValueError("a capacity must be at least 1")
    table = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in sorted(kinds)])
    each = sizes.select("doc_id", F.col("tokens").alias("all"), F.explode(table).alias("k")).select("doc_id", "all", "k.*")
    n = F.ceil(F.col("all") / F.col("capacity")).cast("int")
    cut = each.where("all > 0").select("doc_id", "container_kind", "capacity", "all", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut.select("doc_id", "container_kind", "capacity", "piece", F.least(F.col("capacity"), F.col("all") - F.col("piece") * F.col("capacity")).cast("int").alias("tokens"))


def _parts(pieces: DataFrame, salt: int) -> DataFrame:
    """Adds ``part``: groups of about PIECES_A_PARTITION pieces a kind, by a hash that differs from round to round."""
    n = pieces.groupBy("container_kind").agg(F.ceil(F.count("*") / PIECES_A_PARTITION).cast("int").alias("parts"))
    return pieces.join(n, "container_kind").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.col("parts")).cast("int")).drop("parts")


def pack(docs: DataFrame, capacities: DataFrame, rounds: int | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens, certified): every piece of every document in exactly one container of each kind.

    docs has (doc_id, text). After a round, all bins of certified partitions and the full bins of the others are
    settled; the documents of their other bins change partitions and are packed again, until a round saves no bin (or after ``rounds`` of them).
    """
    pieces = _pieces(written(token_counts(docs, folder=folder)), capacities)  # tokenised once
    caps = {r[0]: r[1] for r in capacities.select("container_kind", "capacity_tokens").distinct().collect()}
    capacity = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(caps.items()) for x in kv]), F.col("container_kind")) if caps else F.lit(None).cast("int")
    done, rest, before, open_, turn = None, pieces, math.inf, None, 0
    bin_ = ["container_kind", "part", "bin"]
    while True:
        packed = written(_parts(rest, turn).groupBy("container_kind", "part").applyInPandas(_pack, PACKED))
        fill = packed.groupBy(bin_).agg(F.sum("tokens").alias("fill"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        fill = written(fill.select(*bin_, ((F.col("bins") <= F.col("bound")) | (F.col("fill") >= capacity)).alias("certified")))
        used, left = fill.agg(F.count("*"), F.count_if(~F.col("certified"))).first()
        last = not left or used >= before or turn == rounds
        named = packed.withColumn("container_id", F.concat_ws("-", F.lit(turn), "part", "bin")).join(fill, bin_)
        # a round that needs more bins than before is dropped for the bins it began with
        settled = (named if used <= before else open_) if last else named.where("certified")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done.select("container_kind", "container_id", "doc_id", "piece", "tokens", "certified")
        rest = packed.join(fill.where("not certified"), bin_, "left_semi").select("doc_id", "container_kind", capacity.alias("capacity"), "piece", "tokens")
        before, open_, turn = left, named.where("not certified"), turn + 1


def quality(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, needed, fill): the containers used against the least that the tokens allow."""
    each = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"))
    total = each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    t = total.join(capacities.select("container_kind", "capacity_tokens").distinct(), "container_kind")
    return t.select("container_kind", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("needed"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
