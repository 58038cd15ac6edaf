import random
from collections import defaultdict

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import mixing, packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
@example({21: 10})
def test_slots_place_every_item_within_capacity(histogram):
    slots, n = packing.plan_slots(histogram, 40)
    used, seen = defaultdict(int), defaultdict(int)
    for size, lo, hi, first, per in slots:
        assert lo == seen[size]
        seen[size] = hi
        for r in range(lo, hi):
            used[first + (r - lo) // per] += size
    assert dict(seen) == histogram and all(u <= 40 for u in used.values()) and set(used) == set(range(n))
    # What best fit in descending order is bound to: 3/2 of the least number. That number is at least the items over half
    # the capacity, and the tokens over the capacity; it is at most 3/2 of the bound that pairs both (Martello and Toth).
    least = max((_bound(histogram, 40, k) for k in range(21)), default=0)
    assert n <= 1.5 * 1.5 * least
    assert sum(u <= 20 for u in used.values()) <= 1  # two containers at most half full would be one


def _bound(histogram, capacity, k):
    """A lower bound of containers: items over capacity - k are alone, those of k to half must share what the large ones leave."""
    alone = sum(n for s, n in histogram.items() if s > capacity - k)
    large = {s: n for s, n in histogram.items() if capacity / 2 < s <= capacity - k}
    small = sum(s * n for s, n in histogram.items() if k <= s <= capacity / 2)
    room = sum((capacity - s) * n for s, n in large.items())
    return alone + sum(large.values()) + max(0, -(-(small - room) // capacity))


def test_many_slots_of_a_frequent_size(spark):
    """A hundred thousand texts of one size in hundreds of slots: one row an item, none lost, the plan kept."""
    random.seed(11)
    sizes = [1] * 100_000 + [min(999, int(random.lognormvariate(5, 1)) + 1) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc long, n int")
    got = packing.pack(df, "doc", F.col("n"), 1000)
    f = packing.fill(got, 1000).first()
    assert got.count() == len(sizes) and f["tokens"] == sum(sizes) and f["fullest"] <= 1000
    histogram = defaultdict(int)
    for s in sizes:
        histogram[s] += 1
    slots, n = packing.plan_slots(histogram, 1000)
    assert f["containers"] == n and sum(s[0] == 1 for s in slots) > 300


def test_long_items_are_cut_and_nothing_is_lost(spark):
    random.seed(7)
    sizes = [random.choice([1, 3, 9, 17, 50, 100, 250]) for _ in range(800)] + [None, 0]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc long, n int, size string")
    got = packing.pack(df, "doc", F.col("n"), 100).collect()
    by, used = defaultdict(int), defaultdict(int)
    for r in got:
        by[r["id"]] += r["size"]
        used[r["container"]] += r["size"]
    assert by == {i: max(s or 1, 1) for i, s in enumerate(sizes)} and max(used.values()) <= 100
    assert all(r["pieces"] == (3 if (sizes[r["id"]] or 1) == 250 else 1) for r in got)
    assert sum(used.values()) / (100 * len(used)) > 0.95
    f = packing.fill(packing.pack(df, "doc", F.col("n"), 100), 100).first()
    assert f["containers"] == len(used) and f["tokens"] == sum(used.values())


def test_pack_empty_repeated_and_null_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc long, n int"), "doc", F.col("n"), 10).collect() == []
    got = packing.pack(spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "doc long, n int"), "doc", F.col("n"), 10).collect()
    assert len(got) == 3 and len({r["container"] for r in got}) == 2


def test_byte_tokens(spark):
    df = spark.createDataFrame([("",), (None,), ("é",), ("a\r\n",)], "t string")
    assert [r[0] for r in df.select(packing.byte_tokens(F.col("t"))).collect()] == [1, 1, 3, 4]


TARGETS = [("big", 0.5, 2), ("Small", 0.3, 2), ("none", 0.2, 4)]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "x") for r in rows], "doc_id long, source string, text string, e double, k string")


def test_mixture_meets_shares_and_caps(spark):
    random.seed(8)
    rows = [(i, " BIG\t", "a" * random.randint(0, 400)) for i in range(900)] + [(1000 + i, "small", "b" * random.randint(0, 400)) for i in range(60)] + [(5000, None, "c"), (5001, "other", "d"), (5002, "small", None)]
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m, report = mixing.mix(documents(spark, rows), t)
    got, r = m.collect(), {x["source"]: x for x in report.collect()}
    copies = defaultdict(int)
    for x in got:
        copies[x["doc_id"]] += 1
    total = sum(len(x[2] or "") + 1 for x in rows if x[1] in (" BIG\t", "small"))
    assert r["Small"]["short"] and r["none"]["short"] and not r["big"]["short"] and r["none"]["docs"] == 0
    assert all(copies[x[0]] == 2 for x in rows if x[1] == "small") and max(copies.values()) == 2
    assert abs(r["big"]["tokens_out"] - 0.5 * total) < 0.01 * total
    assert 5000 not in copies and 5001 not in copies and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9


def test_mix_empty(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m, report = mixing.mix(documents(spark, []), t)
    assert m.collect() == [] and {x["actual_share"] for x in report.collect()} == {0.0}
    m, report = mixing.mix(documents(spark, [(1, "big", "x")]), spark.createDataFrame([], "source string, target_share double, max_repeats int"))
    assert m.collect() == [] and report.collect() == []
