"""Replicas as barrier tasks: each streams its rank's batches, and all add up what they measure after every step."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = "rank int, step int, metric string, total double"
Step = Callable[[pa.Table], dict[str, float]]


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(place, rows) of each step of a stream of rows in the order of their places; one step is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        places = b.column("place").to_pylist()
        cuts = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1]), len(places)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and places[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = places[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def run_replicas(rows: DataFrame, world: int, step: Step, every: int = 64) -> DataFrame:
    """Rows (rank, step, metric, total): what step(rows of one place) returns, summed over the ranks step by step, as every rank
    knows it. rows have rank (0 to world - 1) and place, the number of their step, as equalised() gives them.

    The ranks are the tasks of one barrier stage, so they run at the same time (the cluster needs `world` free slots) and are run
    again together if one is lost. They meet after every `every` steps, each with its sums of these; rows go to no other rank. Sums
    are added in the order of the ranks, so all agree to the last digit. Ranks whose steps are not the same are an error and not
    a wait.
    """
    rows = rows.withColumns({"rank": F.col("rank").cast("int"), "place": F.col("place").cast("int")})
    dealt = rows.repartitionById(world, "rank").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        rank, own = context.partitionId(), steps(batches)
        while True:
            told = []
            for place, table in islice(own, every):
                if set(table.column("rank").to_pylist()) != {rank}:
                    raise ValueError(f"rows of another rank came to rank {rank}")
                told.append((place, {k: float(v) for k, v in step(table).items()}))
            heard = [json.loads(x) for x in context.allGather(json.dumps(told))]
            places = [[p for p, _ in x] for x in heard]
            if any(p != places[0] for p in places):
                raise ValueError(f"ranks take different steps: {places}")
            if not told:
                return
            out = []
            for k, (place, _) in enumerate(told):
                sums = [x[k][1] for x in heard]
                out += [(rank, place, name, sum(s.get(name, 0.0) for s in sums)) for name in sorted({n for s in sums for n in s})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)], ["rank", "step", "metric", "total"])

    return dealt.mapInArrow(run, METRICS, barrier=True)
