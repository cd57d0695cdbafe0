"""Filling fixed-capacity windows with documents: variable-capacity best fit.

Token counts are taken where the documents lie; from then on only
``(doc_id, tokens)`` moves. Best fit needs no document identities, so it runs
on the histogram of piece sizes, which has at most ``capacity`` entries however
many documents there are: sizes from large to small, each piece into the open
window with the least room that still takes it, a new window of the least-cost
permitted capacity where none does, and every window finally downsized to the
smallest permitted capacity that holds its contents. Equal windows are treated
as one run with a multiplicity, which gives the same windows as one by one.

Documents are then ranked within their size by a range partitioning on
(size, hash of id) - a hot size is spread over many tasks - and the rank picks
the window from the run table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.llm.words import TOKENIZER_FILE, token_counter
from formflow.session import cut, spread


@dataclass
class Run:
    """``count`` equal windows: pieces ``(size, how many)`` in order of placing."""

    capacity: int
    count: int
    pieces: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(s * k for s, k in self.pieces)


def best_fit(histogram: dict[int, int], capacities: list[int], overhead: int = 0) -> list[Run]:
    """Windows for all pieces of ``histogram`` (size -> count, sizes 1..max capacity).

    The capacity of a new window is the one of least cost, that is of least
    ``(capacity + overhead) / tokens`` when filled from the pieces still
    unplaced, largest first.
    """
    capacities = sorted(set(capacities))
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    open_runs: dict[int, list[Run]] = {}
    rooms: list[int] = []
    done: list[Run] = []

    def shelve(run: Run) -> None:
        room = run.capacity - run.used()
        if room == 0 or not sizes or room < sizes[0]:
            done.append(run)
            return
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        open_runs[room].append(run)

    def fill(capacity: int, first: int) -> int:
        room, taken = capacity - first, {first: 1}
        limit = bisect_right(sizes, room)
        while limit:
            s = sizes[limit - 1]
            k = min(room // s, left[s] - taken.get(s, 0))
            if k > 0:
                taken[s] = taken.get(s, 0) + k
                room -= k * s
            limit = min(limit - 1, bisect_right(sizes, room))
        return capacity - room

    while sizes:
        s = sizes[-1]
        n = left[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                run = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
            else:
                fits = [c for c in capacities if c >= s]
                capacity = min(fits, key=lambda c: ((c + overhead) / fill(c, s), c)) if len(fits) > 1 else fits[0]
                room, run = capacity, Run(capacity, -(-n // (capacity // s)))
            k = room // s
            whole = min(run.count, n // k)
            if whole:
                shelve(Run(run.capacity, whole, [*run.pieces, (s, k)]))
            n -= whole * k
            rest = run.count - whole
            if rest and n and n < k:
                shelve(Run(run.capacity, 1, [*run.pieces, (s, n)]))
                n, rest = 0, rest - 1
            if rest:
                shelve(Run(run.capacity, rest, run.pieces)) if run.pieces else None
            left[s] = n
        sizes.pop()
        del left[s]
    done += [r for runs in open_runs.values() for r in runs]
    for run in done:
        run.capacity = next(c for c in capacities if c >= run.used())
    return sorted(done, key=lambda r: (-r.used(), r.pieces))


def slots(runs: list[Run]) -> pd.DataFrame:
    """Where the pieces of each size go, in order of their rank within the size."""
    rows, window, rank = [], 0, {}
    for run in runs:
        offset = 0
        for s, k in run.pieces:
            start = rank.get(s, 0)
            rows.append((s, start, k, window, offset, run.capacity))
            rank[s] = start + k * run.count
            offset += s * k
        window += run.count
    return pd.DataFrame(rows, columns=["size", "start", "each", "window", "offset", "capacity"]).sort_values(
        ["size", "start"], ignore_index=True
    )


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``(doc_id, tokens)`` of every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for pdf in batches:
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "tokens": [count(t) if t else 0 for t in pdf["text"]]}
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInPandas(
        run, f"doc_id {kind}, tokens long"
    )


def pack(tokens: DataFrame, capacities: list[int], overhead: int = 0) -> DataFrame:
    """Windows for the documents of ``tokens`` (``doc_id, tokens``).

    One row per piece: ``window_id, capacity, doc_id, piece_no, doc_start,
    tokens, window_offset``. A document is split only if it exceeds the largest
    capacity: into windows of that capacity that it fills, and a rest that is
    packed with the others. Documents without tokens take no space and get no
    row. Rows repeated under one id are separate documents. With one capacity
    all windows have it; with several they are optimised jointly.
    """
    largest = max(capacities)
    base = tokens.filter(F.col("tokens") > 0).select(
        "doc_id",
        "tokens",
        F.floor(F.col("tokens") / largest).cast("long").alias("full"),
        (F.col("tokens") % largest).cast("int").alias("rest"),
    )
    ranked = cut(
        base.repartitionByRange("rest", F.xxhash64("doc_id"), "doc_id")
        .sortWithinPartitions("rest", F.xxhash64("doc_id"), "doc_id")
        .withColumn("row", F.monotonically_increasing_id())
    )
    # A row a task and size, and the tasks' first global ranks.
    per_task = (
        ranked.groupBy(F.shiftright("row", 33).alias("task"), "rest")
        .agg(F.count("*").alias("n"), F.sum("full").alias("full"))
        .toPandas()
    )
    histogram = per_task.groupby("rest")["n"].sum().to_dict() if len(per_task) else {}
    full_windows = int(per_task["full"].sum()) if len(per_task) else 0
    before = per_task.groupby("task")[["n", "full"]].sum().sort_index() if len(per_task) else None
    tasks = {} if before is None else before.cumsum().shift(fill_value=0).to_dict("index")
    first_of_size, total = {}, 0
    for s in sorted(histogram):
        first_of_size[s] = total
        total += histogram[s]
    table = slots(best_fit({int(s): int(n) for s, n in histogram.items() if s > 0}, capacities, overhead))
    span = 1 << 40
    keys = table["size"].to_numpy(np.int64) * span + table["start"].to_numpy(np.int64)
    columns = {c: table[c].to_numpy(np.int64) for c in table}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen_full: dict[int, int] = {}
        for pdf in batches:
            row = pdf["row"].to_numpy(np.int64)
            task = row >> 33
            rest = pdf["rest"].to_numpy(np.int64)
            full = pdf["full"].to_numpy(np.int64)
            out = []
            if len(pdf) == 0:
                continue
            firsts = np.array([tasks[t]["n"] for t in task], dtype=np.int64)
            rank = firsts + (row & ((1 << 33) - 1)) - np.array([first_of_size[s] for s in rest], dtype=np.int64)
            has = rest > 0
            if has.any():
                at = np.searchsorted(keys, rest[has] * span + rank[has], side="right") - 1
                nth = rank[has] - columns["start"][at]
                out.append(
                    pd.DataFrame(
                        {
                            "window_id": full_windows + columns["window"][at] + nth // columns["each"][at],
                            "capacity": columns["capacity"][at],
                            "doc_id": pdf["doc_id"].to_numpy()[has],
                            "piece_no": full[has],
                            "doc_start": full[has] * largest,
                            "tokens": rest[has],
                            "window_offset": columns["offset"][at] + (nth % columns["each"][at]) * rest[has],
                        }
                    )
                )
            if full.any():
                # Windows filled by one document: numbered by a running count within the task.
                starts = np.empty(len(full), dtype=np.int64)
                for t in np.unique(task):
                    mine = task == t
                    c = np.cumsum(full[mine])
                    starts[mine] = tasks[t]["full"] + seen_full.get(t, 0) + c - full[mine]
                    seen_full[t] = seen_full.get(t, 0) + int(c[-1])
                idx = np.repeat(np.arange(len(full)), full)
                piece = np.arange(len(idx)) - np.repeat(np.cumsum(full) - full, full)
                out.append(
                    pd.DataFrame(
                        {
                            "window_id": starts[idx] + piece,
                            "capacity": largest,
                            "doc_id": pdf["doc_id"].to_numpy()[idx],
                            "piece_no": piece,
                            "doc_start": piece * largest,
                            "tokens": largest,
                            "window_offset": 0,
                        }
                    )
                )
            yield from out

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(
        place,
        f"window_id long, capacity int, doc_id {kind}, piece_no int, doc_start long, tokens int, window_offset int",
    )


def pack_each(tokens: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """:func:`pack` for every container kind on its own, all documents in each."""
    parts = [
        pack(tokens, [capacity]).withColumn("container_kind", F.lit(kind)) for kind, capacity in sorted(kinds.items())
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
