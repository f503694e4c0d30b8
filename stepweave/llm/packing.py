"""Filling containers of fixed capacity with texts of varying length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.tokens import TOKENIZER, token_sizes
from stepweave.runtime import cut

#: Items packed together in one task, about.
GROUP = 2048
#: Fill below which a bin's items are packed again, together with those of other groups.
UNDERFULL = 0.97
#: Rounds of packing underfull bins of ever wider origin.
ROUNDS = 3


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the fullest bin that holds it."""
    bins = np.full(len(sizes), -1)
    room = np.empty(len(sizes) + 1, np.int64)
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        fits = np.flatnonzero(room[:n] >= sizes[i])
        if len(fits):
            k = fits[room[fits].argmin()]
        else:
            k, n = n, n + 1
            room[k] = capacity
        room[k] -= sizes[i]
        bins[i] = k
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins, the least full first, by moving single items to fuller bins and exchanging one for one or two for one.

    Each step makes a fuller bin fuller and the bin at hand emptier, so that the sum of squared fills grows and the search ends; a bin that can't be emptied keeps what is left.
    """
    bins = bins.copy()
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    given_up: set[int] = set()
    least = int(-(-int(sizes.sum()) // capacity))
    while (fill > 0).sum() > max(least, 1):
        alive = [b for b in np.flatnonzero(fill > 0) if b not in given_up]
        if not alive:
            break
        at = min(alive, key=lambda b: (fill[b], b))
        while True:  # each step takes from this bin, so at most as many as it has tokens
            own = np.flatnonzero((bins == at) & (sizes > 0))
            if not len(own):
                break
            room = np.where((fill > 0) & (np.arange(n) != at) & (fill >= fill[at]), capacity - fill, -1)
            if _move(sizes, bins, fill, room, own, at) or _exchange(sizes, bins, fill, room, own, at):
                continue
            break
        if fill[at] > 0:
            given_up.add(int(at))
    names = {b: k for k, b in enumerate(dict.fromkeys(bins.tolist()))}
    return np.array([names[b] for b in bins.tolist()], dtype=np.int64)


def _put(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, item: int, to: int) -> None:
    fill[bins[item]] -= sizes[item]
    fill[to] += sizes[item]
    bins[item] = to


def _move(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, room: np.ndarray, own: np.ndarray, at: int) -> bool:
    for i in own[np.argsort(-sizes[own], kind="stable")]:
        fits = np.flatnonzero(room >= sizes[i])
        if len(fits):
            _put(sizes, bins, fill, i, int(fits[room[fits].argmin()]))
            return True
    return False


def _exchange(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, room: np.ndarray, own: np.ndarray, at: int) -> bool:
    """The exchange that fills another bin most: one or two items of this bin for one of that."""
    best = (0, None, None)
    free = room[bins]
    for i in own:
        gain = sizes[i] - sizes
        ok = np.flatnonzero((gain > 0) & (gain <= free) & (sizes > 0))
        if len(ok):
            j = ok[gain[ok].argmax()]
            if gain[j] > best[0]:
                best = (int(gain[j]), (i,), int(j))
    # Two for one: for each first item and each item to be taken out, the largest second one that fits, by binary search.
    mine = own[np.argsort(sizes[own], kind="stable")]
    small = sizes[mine]
    out = np.flatnonzero((free >= 0) & (sizes > 0))
    for k in range(1, len(mine)) if len(out) else ():
        most = sizes[out] + free[out] - small[k]
        second = np.minimum(np.searchsorted(small, most, side="right"), k) - 1
        gain = np.where(second >= 0, small[k] + small[second] - sizes[out], 0)
        j = gain.argmax()
        if gain[j] > best[0]:
            best = (int(gain[j]), (mine[k], mine[second[j]]), int(out[j]))
    if best[1] is None:
        return False
    to = int(bins[best[2]])
    _put(sizes, bins, fill, best[2], at)
    for i in best[1]:
        _put(sizes, bins, fill, i, to)
    return True


_PACKED = "container string, capacity int, grp bigint, bin bigint, doc_id bigint, piece bigint, tokens bigint"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes, capacity = rows["tokens"].to_numpy(np.int64), int(rows["capacity"].iloc[0])
    rows["bin"] = local_search(sizes, best_fit(sizes, capacity), capacity)
    return rows[["container", "capacity", "grp", "bin", "doc_id", "piece", "tokens"]]


def packed_documents(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, bin_id, doc_id, piece, start_token, tokens): the bin of every text, or piece of a text longer than the capacity, for each kind of container.

    Only a text that alone exceeds the capacity is split: into full pieces, which are bins by themselves, and a rest. All others are hashed into groups of about GROUP items; each group is packed by best fit and then by local search. The items of bins that stay underfull are gathered from all groups, hashed into as few groups as hold them, and packed again, ROUNDS times. Groups are bounded, so no source or kind of text can overload a task, and the result is the same on every run.

    Null texts are left out; empty texts have no tokens and take no room; rows repeated under one doc_id are one text; equal sizes go by doc_id; kinds of container that are null or not positive are left out; with no documents or no containers there is no row; other columns are not read.
    """
    sized = cut(token_sizes(documents, tokenizer))
    kinds = containers.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    # One row for each text and kind of container: the kinds are exploded from an array, at most a few.
    wanted = kinds.agg(F.collect_list(F.struct("container", "capacity"))).scalar()
    each = sized.withColumn("k", F.explode(wanted)).select("doc_id", "tokens", "k.*")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    rest = F.col("tokens") - whole * F.col("capacity")
    full = each.where(whole > 0).select("container", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), F.col("capacity").cast("bigint").alias("tokens"))
    full = full.select("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("bin_id"), "doc_id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * F.col("capacity")).cast("bigint").alias("start_token"), "tokens")
    items = each.where((rest > 0) | (F.col("tokens") == 0)).select("container", "capacity", "doc_id", whole.alias("piece"), rest.alias("tokens"))
    count = sized.count()
    done = []
    for turn in range(ROUNDS):
        groups = max(1, -(-count // GROUP))
        packed = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups))).groupBy("container", "grp").applyInPandas(_pack, _PACKED)
        packed = cut(packed)
        fills = packed.groupBy("container", "grp", "bin").agg((F.sum("tokens") < UNDERFULL * F.max("capacity")).alias("under"))
        judged = packed.join(fills, ["container", "grp", "bin"])
        last = turn == ROUNDS - 1 or groups == 1
        stay = packed if last else judged.where("NOT under")
        done.append(stay.select("container", F.concat_ws("-", F.lit(f"r{turn}"), "grp", "bin").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("bigint").alias("start_token"), "tokens"))
        if last:
            break
        items = judged.where("under").select("container", "capacity", "doc_id", "piece", "tokens")
        count = items.groupBy("container").count().agg(F.max("count")).first()[0] or 0
        if not count:
            break
    out = full
    for part in done:
        out = out.unionByName(part)
    return out


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bins, tokens, fill): how full the bins of each kind are."""
    used = packed.groupBy("container").agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    sizes = containers.groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    return used.join(sizes, "container").select("container", "bins", "tokens", F.round(F.try_divide(F.col("tokens"), F.col("bins") * F.col("capacity")), 6).alias("fill"))
