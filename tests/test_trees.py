"""Orders of spans against plain versions."""

import heapq
import random

from pyspark.sql import functions as F

from tracelake.operators import projections as P
from tracelake.operators.trees import clock_order
from tracelake.sources.common import SPANS, completed


def queue_order(spans):
    """Ids in the order of a queue that gives the earliest span whose parent is out; spans: {id: (parent, start, tie)}."""
    children, ready, out = {}, [], []
    for i, (parent, start, tie) in spans.items():
        if parent is None:
            heapq.heappush(ready, (start, tie, i))
        children.setdefault(parent, []).append(i)
    while ready:
        out.append(heapq.heappop(ready)[2])
        for i in children.get(out[-1], []):
            heapq.heappush(ready, (*spans[i][1:], i))
    return out


def test_clock_order_is_that_of_a_queue(spark):
    """Trees of every shape, clocks that run backwards, starts that tie and are told apart by the source or by id."""
    rng, rows, want = random.Random(3), [], {}
    for t in range(120):
        n, deep = rng.randint(1, 25), t % 3
        spans = {}
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.15 else f"s{i - 1 if deep == 0 else rng.randrange(i) if deep == 1 else i // 4}"
            spans[f"s{i}"] = (parent if parent != f"s{i}" else None, rng.randint(0, 6), rng.choice(["", "", "a", "b"]))
        want[f"t{t}"] = queue_order(spans)
        rows += [(f"t{t}", i, *v) for i, v in spans.items()]
    rows.append(("loop", "a", "b", 1, ""))
    rows.append(("loop", "b", "a", 1, ""))
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start int, tie string").repartition(3)
    got = {}
    for r in clock_order(df).orderBy("trace_id", "clock_index").collect():
        got.setdefault(r.trace_id, []).append(r.span_id)
    assert got == want


def test_calls_are_numbered_by_the_clock(spark):
    """Two branches in parallel: their calls alternate, though depth first one branch comes after the other."""
    rows = [("t", "root", None, "AGENT", 0), ("t", "a", "root", "AGENT", 1), ("t", "b", "root", "AGENT", 2), *(("t", f"{x}{i}", x, "TOOL", 3 + 2 * i + (x == "b")) for x in "ab" for i in range(3))]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, kind string, s int").withColumn("start", F.timestamp_seconds("s"))
    spans = completed(spans, SPANS)
    number = lambda df: [r.span_id for r in P.visits(df).where("kind = 'TOOL'").orderBy("tool_number").collect()]
    assert number(spans) == ["a0", "a1", "a2", "b0", "b1", "b2"] and number(clock_order(spans)) == ["a0", "b0", "a1", "b1", "a2", "b2"]
