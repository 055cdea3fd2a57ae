import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloneloom.llm import mixing


def brute_targets(sizes):
    """Share the budget by weight; hand the excess of capped sources on until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(capped.values())


SHAPES = [
    {"a": 10, "b": 10, "c": 10},
    {"a": 1000, "b": 10, "c": 10, "d": 300},
    {"a": 1, "b": 1, None: 5000},
    {"é": 40, "z": 7, "Z": 500, "": 3},
    {f"s{i}": 5 + i * i for i in range(20)},
]


@pytest.mark.parametrize("sizes", SHAPES)
def test_targets_by_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken string")


def sample(n=300):
    draw = random.Random(3)
    out = []
    for i in range(n):
        source = draw.choice(["a", "a", "a", "a", "b", "c", None])
        text = None if i % 50 == 7 else " ".join(["w"] * draw.choice([0, 1, 5, 40, 300]))
        out.append((i, text, "en", source, len(text or ""), "clash"))
    return out


def test_schedule_meets_targets(spark):
    rows = mixing.fair_schedule(documents(spark, sample())).collect()
    assert len(rows) == 300
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(r.takes)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.PACKET
        assert own[0].source_size == sum(r.size for r in own)
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    again = mixing.fair_schedule(documents(spark, sample()).repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_documents_follow_the_schedule(spark):
    docs = documents(spark, sample()).drop("taken")
    schedule = mixing.fair_schedule(docs)
    want = {r.doc_id: r.taken for r in schedule.collect() if r.taken}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == want


def test_rows_of_one_id_and_size_follow_their_own_schedules(spark):
    rows = [(1, " ".join(f"{s}{i}w{k}" for k in range(100)), "en", s, 0) for s in "ab" for i in range(20)] + [(1, " ".join(["b"] * 100), "en", "b", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len(r.text.split())
    targets = brute_targets({"a": 2000, "b": 2300})
    assert sum(taken.values()) == 4300 and all(abs(taken[s] - targets[s]) <= mixing.PACKET for s in "ab")


def test_empty_ties_and_repeats(spark):
    assert mixing.fair_schedule(documents(spark, [])).count() == 0
    same = [(1, "a b", "en", "s", 3, "x")] * 4 + [(2, None, None, None, None, None), (None, "x", "en", "s", 1, "x")]
    rows = mixing.fair_schedule(documents(spark, same)).collect()
    assert len(rows) == 6 and sum(r.taken for r in rows) == 9


def brute_schedule(rows, packet):
    """Words taken of each (document, pass): packets of all sources in one list, sorted by finish time and cut at the budget."""
    import hashlib

    queues, sizes = defaultdict(list), defaultdict(int)
    for i, text, source in rows:
        size = len((text or "").split())
        sizes[source] += size
        queues[source].append((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, size))
    targets, packets = brute_targets(sizes), []
    for source, queue in queues.items():
        at = 0
        for e in range(3):
            for _, i, size in sorted(queue):
                for k in range(0, size, packet):
                    n = min(packet, size - k)
                    if (at + k) / targets[source] < 1:
                        packets.append(((at + k + n) / targets[source], source is not None, source or "", (i, e), n))
                at += size
    left, taken = sum(sizes.values()), defaultdict(int)
    for *_, turn, n in sorted(packets):
        taken[turn] += min(n, left)
        left -= min(n, left)
    return taken


@pytest.mark.parametrize("packet,ranges", [(64, 1024), (7, 3), (10_000, 1)])
def test_schedule_equals_a_sorted_list(spark, packet, ranges):
    rows = sample()
    want = brute_schedule([(r[0], r[1], r[3]) for r in rows], packet)
    got = {r.doc_id: r.takes for r in mixing.fair_schedule(documents(spark, rows), packet=packet, ranges=ranges).collect()}
    assert got == {r[0]: [want[r[0], e] for e in range(3)] for r in rows}


def test_rows_without_ids_are_spread_by_their_texts(spark):
    rows = [(None, f"w{i} x", "en", "s", 3, "") for i in range(200)] + [(None, None, None, None, None, None)] * 2
    queue = mixing.queued_documents(documents(spark, rows), 42, (1, 2, 3), 3, 2)
    assert queue.count() == 202 and queue.where("size > 0").select("through").distinct().count() == 200
    assert mixing.fair_schedule(documents(spark, rows)).count() == 202


def test_native_plan(spark):
    out = mixing.fair_schedule(documents(spark, sample(5)))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_the_sort_decides_what_is_taken(spark):
    plan = mixing.fair_schedule(documents(spark, sample(5)))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("RepartitionByExpression [range")], plan[plan.index("RepartitionByExpression [range") :]
    assert "AS taken" in above and "AS sent" in above and "AS taken" not in below and "virtual_finish" in below
