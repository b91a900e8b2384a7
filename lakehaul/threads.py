"""Several Spark jobs at a time from one driver."""

from __future__ import annotations

import heapq
import itertools
import threading
from collections import deque
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Each thread's jobs are a pool of their own; it matters where the session is submitted
# with spark.scheduler.mode=FAIR, so that a huge job leaves room for small ones.
POOL = "spark.scheduler.pool"


def in_threads(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Runs ``work`` on every item, ``parallelism`` at a time; results in order.

    Spark runs jobs from several driver threads side by side.
    """
    if parallelism <= 1 or len(items) <= 1:
        return [work(item) for item in items]
    with ThreadPoolExecutor(min(parallelism, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def largest_first(
    spark: SparkSession,
    groups: Sequence,
    expand: Callable[[object], list[tuple[int, object]]],
    work: Callable[[object], None],
    parallelism: int,
) -> None:
    """Expands every group into sized items and works on those, the largest known one first.

    ``parallelism`` threads share both.  Groups are taken before items, so sizes are known
    early, but a thread that finds all groups taken starts on the items listed so far and
    does not wait for the slowest listing.  An error ends the whole call, after the work that
    already runs.
    """
    waiting, ready, expanding = deque(groups), [], 0
    arrival, changed = itertools.count(), threading.Condition()

    def run(number: int) -> None:
        nonlocal expanding
        before = spark.sparkContext.getLocalProperty(POOL)
        spark.sparkContext.setLocalProperty(POOL, f"lakehaul-{number}")
        try:
            while True:
                with changed:
                    while not waiting and not ready and expanding:
                        changed.wait()
                    if waiting:
                        group, item, expanding = waiting.popleft(), None, expanding + 1
                    elif ready:
                        group, (_, _, item) = None, heapq.heappop(ready)
                    else:
                        return
                if item is not None:
                    work(item)
                    continue
                found: list = []
                try:
                    found = expand(group)
                finally:
                    with changed:
                        expanding -= 1
                        for size, each in found:
                            heapq.heappush(ready, (-size, next(arrival), each))
                        changed.notify_all()
        except BaseException:
            with changed:
                waiting.clear()
                ready.clear()
                changed.notify_all()
            raise
        finally:
            spark.sparkContext.setLocalProperty(POOL, before)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        # Each thread gets properties of its own: one target would share them.
        targets = [inheritable_thread_target(spark)(run) for _ in range(max(1, parallelism))]
        for done in [pool.submit(target, number) for number, target in enumerate(targets)]:
            done.result()
