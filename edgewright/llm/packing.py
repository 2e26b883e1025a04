"""Fill fixed-capacity containers with items, splitting only what exceeds the capacity.

Method: Karmarkar-Karp multiway differencing.  Every item starts as a partial partition of its own;
the two partial partitions with the largest differences are merged again and again, the fullest
windows of one with the emptiest of the other, so that opposing imbalances cancel and the windows come
out near-equal.  It starts from the least number of windows the sizes allow.  Where a window exceeds
the capacity, items move to windows with room, if need be in exchange for smaller ones; what finds no
place raises the window count.  Then the unused space is driven into the last windows, which may empty
them, and the next window count is tried as long as it can still be better.

Items are spread over shards of some ``WINDOWS`` containers by a hash; a shard is packed in one task.
The number of shards follows the total size, so the work per task doesn't grow with the data, and the
rounding costs at most one part-filled container per shard.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm import tokens
from edgewright.runtime import Stage

WINDOWS = 256
PASSES = 6


def least_windows(sizes: Sequence[int], capacity: int) -> int:
    """A lower bound: total size, and for each threshold what large items leave over."""
    total = sum(sizes)
    best = -(-total // capacity)
    ordered = sorted(sizes)
    n = len(ordered)
    sums = [0]
    for s in ordered:
        sums.append(sums[-1] + s)
    half = bisect_left(ordered, capacity // 2 + 1)
    for lo in sorted({s for s in ordered if s <= capacity // 2}) or [0]:
        big = bisect_left(ordered, capacity - lo + 1)
        i = bisect_left(ordered, lo)
        alone, large = n - big, big - half
        room = large * capacity - (sums[big] - sums[half])
        rest = sums[half] - sums[i]
        best = max(best, alone + large + max(0, -(-(rest - room) // capacity)))
    return max(1, best)


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Item numbers of ``k`` windows by multiway differencing."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s if k > 1 else 0, i, [(s, [i])]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:  # the fullest of b take the empty windows, the others join the emptiest of a, opposed
            merged = list(a)
            merged += b[:free]
            rest = b[free:]
            at = len(a) - 1
            for s, members in rest:
                t, own = a[at]
                merged[at] = (t + s, own + members)
                at -= 1
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tick, merged))
        tick += 1
    return [m for _, m in heap[0][2]] if heap else []


def repaired(sizes: Sequence[int], windows: list[list[int]], k: int, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Windows within the capacity, and the items that found no place."""
    windows = [list(w) for w in windows] + [[] for _ in range(k - len(windows))]
    loads = [sum(sizes[i] for i in w) for w in windows]
    out: list[int] = []
    for w, members in enumerate(windows):
        if loads[w] <= capacity:
            continue
        members.sort(key=lambda i: sizes[i])
        while loads[w] > capacity:
            over = loads[w] - capacity
            i = next((i for i in members if sizes[i] >= over), members[-1])  # smallest that cures it
            members.remove(i)
            loads[w] -= sizes[i]
            out.append(i)
    slack = sorted((capacity - load, w) for w, load in enumerate(loads))
    left = []
    waiting = [(-sizes[i], i) for i in out]
    heapq.heapify(waiting)
    while waiting:
        size, i = heapq.heappop(waiting)
        size = -size
        at = bisect_left(slack, (size, -1))
        if at < len(slack):
            room, w = slack.pop(at)
            windows[w].append(i)
            insort(slack, (room - size, w))
            continue
        # put it in the place of the smallest item whose window then holds it; sizes only fall, so this ends
        swap = min(((sizes[j], at, j) for at, (room, w) in enumerate(slack) if room for j in windows[w] if size - room <= sizes[j] < size), default=None)
        if swap is None:
            left.append(i)
            continue
        _, at, j = swap
        room, w = slack.pop(at)
        windows[w].remove(j)
        windows[w].append(i)
        insort(slack, (room + sizes[j] - size, w))
        heapq.heappush(waiting, (-sizes[j], j))
    return windows, left


def tightened(sizes: Sequence[int], windows: list[list[int]], capacity: int) -> list[list[int]]:
    """The same items in the same or fewer windows.

    Differencing spreads the unused space evenly.  Window by window, the fullest first, an item is
    exchanged for the larger one of a later window that fills it best, or one is moved in, which
    drives the unused space into the last windows until they are empty.  A later window only ever
    loses, so none exceeds the capacity.
    """
    windows = sorted((list(w) for w in windows if w), key=lambda w: -sum(sizes[i] for i in w))
    owner = {i: n for n, w in enumerate(windows) for i in w}
    pool = sorted((sizes[i], i) for i in owner)
    for n, w in enumerate(windows):
        for i in w:
            del pool[bisect_left(pool, (sizes[i], i))]
        room = capacity - sum(sizes[i] for i in w)
        while room and pool:
            at = bisect_left(pool, (room + 1, -1)) - 1
            best = (pool[at][0], at, None) if at >= 0 else (0, -1, None)
            for i in w:
                at = bisect_left(pool, (sizes[i] + room + 1, -1)) - 1
                if at >= 0 and pool[at][0] - sizes[i] > best[0]:
                    best = (pool[at][0] - sizes[i], at, i)
            gain, at, out = best
            if gain <= 0:
                break
            _, j = pool.pop(at)
            windows[owner[j]].remove(j)
            if out is not None:
                w.remove(out)
                windows[owner[j]].append(out)
                owner[out] = owner[j]
                insort(pool, (sizes[out], out))
            w.append(j)
            owner[j] = n
            room -= gain
    return [w for w in windows if w]


def _first_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows for the few items that found no place, the largest first."""
    out: list[list[int]] = []
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((n for n, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            out.append([i])
            room.append(capacity - sizes[i])
        else:
            out[at].append(i)
            room[at] -= sizes[i]
    return out


def pack(sizes: Sequence[int], capacity: int) -> list[int]:
    """Window number of each item; every item must fit the capacity."""
    if not sizes:
        return []
    least = k = least_windows(sizes, capacity)
    best: list[list[int]] | None = None
    while best is None or k < len(best):
        windows, left = repaired(sizes, difference(sizes, k), k, capacity)
        if left:  # the window count rises by what holds the rest
            windows += [[left[i] for i in w] for w in _first_fit([sizes[i] for i in left], capacity)]
        for _ in range(PASSES):
            before, windows = len(windows), tightened(sizes, windows, capacity)
            if len(windows) in (before, least):
                break
        if best is None or len(windows) < len(best):
            best = windows
        if len(best) == least or not left:
            break
        k += 1
    where = [0] * len(sizes)
    for n, w in enumerate(best):
        for i in w:
            where[i] = n
    return where


_PACKED = "container_kind string, doc_id long, piece_no int, n_tokens int, shard long, window int"


def _pack_shard(capacity_of: dict[str, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
        pdf["window"] = pack(pdf["n_tokens"].tolist(), int(capacity_of[pdf["container_kind"].iat[0]]))
        return pdf[["container_kind", "doc_id", "piece_no", "n_tokens", "shard", "window"]]

    return run


def packed(sized: DataFrame, containers: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """``container_kind, doc_id, piece_no, n_tokens, container_id``: each item of ``sized(doc_id,
    n_tokens)`` in a container of every kind of ``containers(container_kind, capacity_tokens)``.

    An item above the capacity is split into pieces of the capacity, which fill a container each, and
    a rest, which is packed like any item; ``piece_no`` counts from 0.  Items of size 0 or null (as 0)
    take part and use no space.  Repeated rows are items of their own; a null doc_id is left out, as is a kind without a
    positive capacity.  Containers are a short list: at most 1000 kinds, else ValueError.
    """
    kinds = {r.container_kind: r.capacity_tokens for r in containers.where("capacity_tokens > 0 and container_kind is not null").limit(1001).collect()}
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    spark = sized.sparkSession
    items = sized.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"))
    total = items.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    if not kinds:
        return spark.createDataFrame([], "container_kind string, doc_id long, piece_no int, n_tokens int, container_id string")
    shards = lambda cap: max(1, -(-int(total.t or 0) // (cap * windows)), -(-total.n // 20_000))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).alias("cap"), F.lit(shards(int(c))).alias("shards")) for k, c in sorted(kinds.items()))))
    spread = items.select("doc_id", "n_tokens", each.alias("k")).select("doc_id", "n_tokens", "k.*")
    full = spread.where("n_tokens >= cap").select("container_kind", "doc_id", "cap", F.explode(F.sequence(F.lit(0), F.expr("int(n_tokens div cap) - 1"))).alias("piece_no"))
    whole = full.select("container_kind", "doc_id", "piece_no", F.col("cap").alias("n_tokens"), F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece_no").alias("container_id"))
    rest = spread.where("n_tokens = 0 or n_tokens % cap > 0").select("container_kind", "doc_id", F.expr("int(n_tokens div cap)").alias("piece_no"), F.expr("n_tokens % cap").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.col("shards")).alias("shard"))
    inside = rest.groupBy("container_kind", "shard").applyInPandas(_pack_shard(kinds), _PACKED)
    return whole.unionByName(inside.select("container_kind", "doc_id", "piece_no", "n_tokens", F.concat_ws("-", "container_kind", "shard", "window").alias("container_id")))


def packed_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """:func:`packed` for documents measured in tokens; the sizes are counted once and staged."""
    sized = Stage(documents.sparkSession, "packing").write(tokens.counted(documents, vocabulary), "sizes")
    return packed(sized, containers)
