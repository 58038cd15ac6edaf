import random

from pointloom.llm import pieces


def points(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "file_id long, point_id long, gps_time double, pos int, part string")


def cut_up(spark, rows, limit, overlap, gap=2.0):
    o = pieces.ordered(points(spark, rows), "file_id", "point_id", "gps_time", gap)
    t = pieces.starts(o, gap)
    b = pieces.boundaries(o, t, limit)
    p = pieces.pieces(b, t, limit, overlap)
    return b, p, pieces.members(o, t, p, limit)


def test_pieces_hold_all_points_and_cut_at_gaps(spark):
    random.seed(6)
    rows, i = [], 0
    for f in range(4):
        t = 100.0
        for _ in range([50, 900, 2500, 300][f]):
            t += 5.0 if random.random() < 0.01 else 0.1
            i += 1
            rows.append((f, i, t))
    shuffled = rows + random.sample(rows, 200)
    random.shuffle(shuffled)
    b, p, m = cut_up(spark, shuffled, 400, 30)
    order = {f: sorted((t, i) for g, i, t in rows if g == f) for f in range(4)}
    gaps = {(f, b[1]) for f in (1, 2) for a, b in zip(order[f], order[f][1:]) if b[0] - a[0] >= 2.0}
    assert {(r["file"], r["id"]) for r in b.collect()} == gaps
    by = {}
    for r in p.collect():
        by.setdefault(r["file"], []).append(r)
    assert set(by) == {1, 2}
    at = {(r["file"], r["id"]): r["at"] for r in b.collect()}
    for f, own in by.items():
        own.sort(key=lambda r: r["piece"])
        assert own[0]["first"] == 0 and own[-1]["last"] == len(order[f]) - 1 and [r["piece"] for r in own] == list(range(len(own)))
        places = sorted(v for (g, _), v in at.items() if g == f)
        for x, y in zip(own, own[1:]):
            assert x["n"] <= 400 and x["last"] - y["first"] + 1 == 30
            start = x["first"] + (30 if x["piece"] else 0)
            within = [q for q in places if start < q <= x["first"] + 400]
            assert x["natural"] == bool(within) and (not within or x["last"] + 1 in places)
    got = {}
    for r in m.collect():
        got.setdefault((r["file"], r["piece"]), []).append((r["at"], r["id"]))
    for f, own in by.items():
        for r in own:
            assert [i for _, i in sorted(got[f, r["piece"]])] == [i for _, i in order[f][r["first"] : r["last"] + 1]]


def test_stretches_join_without_loss(spark, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 3)
    rows = [(1, i, float(i) * 0.5 + (3.0 * (i // 40))) for i in range(1000)]
    _, p, m = cut_up(spark, rows, 50, 10)
    own = sorted(p.collect(), key=lambda r: r["piece"])
    assert own[0]["first"] == 0 and own[-1]["last"] == 999
    assert all(x["last"] - y["first"] + 1 == 10 and x["n"] <= 50 for x, y in zip(own, own[1:]))
    assert {r["id"] for r in m.collect()} == set(range(1000))


def test_no_gap_ties_and_bad_times(spark):
    rows = [(1, i, 5.0) for i in range(30)] + [(1, 99, None), (1, 98, float("nan")), (None, 1, 1.0), (1, None, 1.0)]
    b, p, m = cut_up(spark, rows, 10, 2)
    assert b.collect() == [] and all(not r["natural"] for r in p.collect() if r["last"] < 31)
    assert {r["id"] for r in m.collect()} == {*range(30), 98, 99}


def test_empty_and_exact_size(spark):
    assert [x.collect() for x in cut_up(spark, [], 10, 2)] == [[], [], []]
    assert [x.collect() for x in cut_up(spark, [(1, i, float(i)) for i in range(10)], 10, 2)] == [[], [], []]
