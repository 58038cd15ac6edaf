import itertools
import random

import pytest
from pyspark.sql import functions as F

from pointloom.llm import splits

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


@pytest.mark.parametrize(
    "path, key",
    [
        ("/d/20210401/HD_LIDARHD_FXX_0645_6697_PTS_C_LAMB93_ALT69.laz", "0645_6697"),
        ("s3://b/X0120Y6050_epsg2154.LAZ", "0120_6050"),
        ("./out/112000_6044000/points.laz", "0112_6044"),
        ("/in/E584500-N6994500_v1.copc.laz", "0584_6994"),
        ("/in/N6994500-E1020500_v1.laz", "1020_6994"),
        ("file:///s/Mes%20Tuiles/vol040/LHD%5FFXX%5F0518%5F6492%5FPTS.laz", "0518_6492"),
        ("D:\\lidar\\lot-103\\lhd_fxx_0881_7022_pts_c_lamb93_alt69.laz", "0881_7022"),
        ("patches/lod2/LHD_FXX_0987_7135_patch_0744.npz", "0987_7135"),
        ("/in/0121_6050/v5/cloud_20240523.laz", "0121_6050"),
        ("/d/dalle_532_7093.laz", "0532_7093"),
        ("./out/campagne_128/0252-6050_20220925.laz", "0252_6050"),
        ("/x//lot190/../lot190/LHD_FXX_0521_6718_PTS_O_20221017_089a6735.laz.bak", "0521_6718"),
        ("/d/lot_123_0112_6044.laz", "0112_6044"),
        ("/d/20220224/scan_7568.laz", None),
        ("./out/lot-093/bloc_31/merged_20210113.copc.laz", None),
        ("/x/vol_099/upload_35448707.laz", None),
        ("", None),
        (None, None),
    ],
)
def test_tile_key(spark, path, key):
    assert spark.createDataFrame([(path,)], "p string").select(splits.tile_key("p").alias("k")).first()["k"] == key


def test_groups_stay_together_and_shares_are_met(spark):
    rows = [(i, f"t{i % 37}" if i % 5 else None, "a" if i % 3 else "b", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, tile string, lab string, grp int")
    got = splits.grouped_split(df, "id", ["tile"], SHARES, "lab").collect()
    assert len(got) == 2000 and len({r["id"] for r in got}) == 2000
    by = {}
    for r in got:
        by.setdefault(r["grp"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    for s, share in SHARES.items():
        assert abs(sum(r["split"] == s for r in got) / 2000 - share) < 0.03


def test_several_keys_link_over_others(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", "y"), (5, None, None), (5, None, None), (6, "b", "z")]
    df = spark.createDataFrame(rows, "id long, k1 string, k2 string")
    got = {r["id"]: r["grp"] for r in splits.group_keys(df, "id", ["k1", "k2"]).collect()}
    assert got[1] == got[2] == got[3] == got[6] and len({got[1], got[4], got[5]}) == 3


def test_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    got = splits.grouped_split(df, "id", ["k"], SHARES).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2400, "val": 300, "test": 300}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "id long, k string")
    assert splits.grouped_split(df, "id", ["k"], SHARES).collect() == []
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "id long, k string")
    assert [r["id"] for r in splits.grouped_split(df, "id", ["k"], SHARES).collect()] == [1]


def test_allocation_is_whole_and_proportional():
    bundles = [(1, (), 1000), (7, (("a", 7),), 30), (500, (), 1)]
    plan = splits.allocate(bundles, SHARES)
    assert [sum(t.values()) for t in plan] == [1000, 30, 1]
    got = {s: sum(size * t[s] for (size, _, _), t in zip(bundles, plan)) for s in SHARES}
    assert abs(got["val"] - 171) <= 7 and abs(got["test"] - 171) <= 7


@pytest.mark.parametrize("seed", range(12))
def test_flow_equals_the_exact_solution(seed):
    """Components of one size: no whole plan of any kind has a lower cost (every one is tried)."""
    rng = random.Random(seed)
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    bundles = [(rng.choice([3]), ((lab, 3),), rng.randint(1, 5)) for lab in rng.choices("xyz", k=rng.randint(2, 4))]
    bundles = list({b[1]: b for b in bundles}.values())
    ways = [[(i, j, n - i - j) for i in range(n + 1) for j in range(n + 1 - i)] for _, _, n in bundles]
    best = min(splits.deviation(bundles, [dict(zip("abc", w)) for w in ws], shares) for ws in itertools.product(*ways))
    assert splits.deviation(bundles, splits.allocate(bundles, shares), shares) <= best + 1e-3


@pytest.mark.parametrize("seed", range(6))
def test_mixed_sizes_are_near_the_exact_solution(seed):
    rng = random.Random(seed)
    shares = {"a": 0.6, "b": 0.4}
    bundles = [(size, (("x", size - size // 2), ("y", size // 2)) if size > 1 else (("x", 1),), rng.randint(1, 4)) for size in (1, 2, 5, 9)]
    ways = [range(n + 1) for _, _, n in bundles]
    best = min(splits.deviation(bundles, [{"a": w, "b": b[2] - w} for w, b in zip(ws, bundles)], shares) for ws in itertools.product(*ways))
    assert splits.deviation(bundles, splits.allocate(bundles, shares), shares) <= best + 1.5


def test_a_hot_component_with_labels_keeps_the_label_shares():
    """A component of a third of all rows, mostly of one label: the others make up for it in exact counts."""
    bundles = [(190_001, (("cloud", 190_000), ("patch", 1)), 1), (1, (("cloud", 1),), 200_000), (1, (("patch", 1),), 180_000)]
    plan = splits.allocate(bundles, SHARES)
    for s, share in SHARES.items():
        cloud, patch = (sum(dict(p).get(lab, 0) * t[s] for (_, p, _), t in zip(bundles, plan)) for lab in ("cloud", "patch"))
        assert abs(cloud - share * 390_000) < 3 and abs(patch - share * 180_001) < 3


def test_many_bundles_are_planned_quickly():
    rng = random.Random(5)
    bundles = [(size, (("a", k), ("b", size - k)) if 0 < k < size else (("a", size),), rng.randint(1, 50)) for size in range(2, 60) for k in range(1, size)]
    plan = splits.allocate(bundles, SHARES)
    total = sum(s * n for s, _, n in bundles)
    assert all(sum(t.values()) == n for t, (_, _, n) in zip(plan, bundles))
    for s, share in SHARES.items():
        assert abs(sum(size * t[s] for (size, _, _), t in zip(bundles, plan)) - share * total) < 5
