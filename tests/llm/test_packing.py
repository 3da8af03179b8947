import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import packing


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")


def filled(df):
    w = defaultdict(int)
    for r in df.collect():
        w[r.window_id] += r.n_tokens
    return w


def test_differencing_is_near_equal():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 500) for _ in range(800)]
    sets = packing.differencing(sizes, 16)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(800)) and max(sums) - min(sums) <= 2


def test_window_count_rises_when_needed():
    # three of 6 need three windows of 10, though their sum fits two
    assert len(packing.pack([6, 6, 6], 10)) == 3
    assert packing.pack([], 10) == []


@pytest.mark.parametrize("capacity", [100, 1000])
def test_nothing_is_lost_or_split_needlessly(spark, capacity):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, rnd.randrange(1, capacity), capacity, capacity * 3 + 7])) for i in range(2000)] + [(None, 9), (7, 9), (7, 9), (8, None)]
    df = packing.windows(items(spark, rows), capacity, windows_per_group=8)
    pieces = df.collect()
    assert sum(r.n_tokens for r in pieces) == sum(n or 0 for _, n in rows)
    assert max(filled(df).values()) <= capacity
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    for i, n in rows[:2000]:
        if i in (7, 8):
            continue
        got = sorted(by[i], key=lambda r: r.piece_no)
        assert len(got) == -(-n // capacity) and [r.token_start for r in got] == [k * capacity for k in range(len(got))]


def test_little_space_is_left(spark):
    rnd = random.Random(3)
    df = packing.windows(items(spark, [(i, min(2000, int(rnd.lognormvariate(4.5, 1)) + 1)) for i in range(8000)]), 2048)
    w = filled(df)
    assert sum(w.values()) / (2048 * len(w)) > 0.96


def test_empty(spark):
    assert packing.windows(items(spark, []), 10).count() == 0


def test_packing_is_spread_over_tasks(spark):
    """Tasks are counted in groups, as sizes are far too small for a task to be made of bytes."""
    df = packing.windows(items(spark, [(i, 20 + i % 200) for i in range(30000)]), 1000, windows_per_group=32)
    tasks = df.filter("window_id like 'g-%'").select("window_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.countDistinct(F.split_part("window_id", F.lit("-"), F.lit(2))).alias("groups")).collect()
    assert len(tasks) > 4 and max(r.groups for r in tasks) < 40
    w = filled(df)
    assert sum(w.values()) / (1000 * len(w)) > 0.97
