"""Splits that keep related records together."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.graph import components
from pointloom.operators.rank import ranked
from pointloom.runtime import cut, only, partitions

# The range of kilometre columns and rows of the projection (EPSG:2154) over its area of use.
COLUMNS_KM, ROWS_KM = (0, 1300), (6000, 7200)

#: Coordinates in a path: two numbers with at most a separator and a letter between them, in metres or kilometres. The
#: second number is only looked at, so it may also be the first of another pair.
_METRES = r"(?<![0-9])([0-9]{6,7})(?=[^a-z0-9]{0,2}[a-z]?[^a-z0-9]{0,2}([0-9]{7})(?![0-9]))"
_NORTH_FIRST = r"n([0-9]{7})(?=[^a-z0-9]{0,2}e([0-9]{6,7})(?![0-9]))"
_KM = r"(?<![0-9])([0-9]{3,4})(?=(?:[^a-z0-9/]{1,2}[a-z]?|y)([0-9]{4})(?![0-9]))"


#: Label profiles of one size are told apart by a hash of so many values.
PROFILES = 4096


def tile_key(path: str) -> Column:
    """The tile a path names, as ``column_row`` in kilometres with four digits each; NULL where it names none.

    Percent-encoded characters are decoded, case and kinds of slash don't matter. Metres name the tile they lie in.
    Pairs outside the projection's area (dates, versions, patch numbers, codes) name nothing. Of several pairs the last
    valid one counts: the file's own name comes after its folders.
    """
    text = F.lower(F.regexp_replace(F.col(path), r"\\", "/"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "%5f", "_"), "%2d", "-"), "%20|%2f", "/")

    def pairs(pattern: str, unit: int, x: int = 1, y: int = 2) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), x).alias("x"), F.regexp_extract_all(text, F.lit(pattern), y).alias("y"))
        return F.transform(zipped, lambda p: F.struct(*[F.floor(p[c].cast("int") / unit).cast("int").alias(c) for c in "xy"]))

    every = F.concat(pairs(_KM, 1), pairs(_NORTH_FIRST, 1000, 2, 1), pairs(_METRES, 1000))
    valid = F.filter(every, lambda p: p["x"].between(*COLUMNS_KM) & p["y"].between(*ROWS_KM))
    return F.when(F.size(valid) > 0, F.format_string("%04d_%04d", F.element_at(valid, -1)["x"], F.element_at(valid, -1)["y"]))


def group_keys(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """``id, grp``: one row per id; ids that share a non-NULL value of any key, also over others, have one ``grp``.

    A single key is its own group and needs no graph: ``grp`` is the key's value, of an id with several rows the
    smallest of its values after their values were joined. An id without any key is a group of its own, ``'id:<id>'``.
    """
    base = only(df, id_col, *keys).where(F.col(f"`{id_col}`").isNotNull())
    pairs = None
    for k in keys:
        one = base.where(F.col(f"`{k}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.concat(F.lit(f"{k}:"), F.col(f"`{k}`").cast("string")).alias("key")).distinct()
        pairs = one if pairs is None else pairs.union(one)
    ids = base.select(F.col(f"`{id_col}`").alias("id")).distinct()
    several = pairs.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    links = several.where("key <> other")
    if links.isEmpty():
        grp = several.select("id", F.col("key").alias("grp"))
    else:
        first = pairs.join(several.select("id", F.col("key").alias("lowest")), "id").where("key <> lowest")
        comp = components(first.select(F.col("lowest").alias("a"), F.col("key").alias("b")))
        grp = several.join(comp, F.col("key") == F.col("node"), "left").select("id", F.coalesce("component", "key").alias("grp"))
    return ids.join(grp, "id", "left").select("id", F.coalesce("grp", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("grp"))


class Rounding:
    """The residual graph that rounds the fractional quotas of bundles of one size: a min-cost flow of whole components.

    source -> bundle (components left over) -> (label, split) -> split -> sink. An arc from a bundle to a split carries
    one component and costs its distance from the bundle's quota there; the arcs of labels and splits are convex: each
    further component costs the growth of the squared deviation from what is left of their quota. Every augmentation
    takes the cheapest path, with residual arcs that send components placed before on to other splits, so the flow is
    the cheapest one and integral. Bundles are contracted: of those that may move from one split to another only the
    cheapest is an arc, so a path is searched in (labels + 1) x splits nodes.
    """

    def __init__(self, size: int, splits: list[str], room: dict, label_room: dict):
        self.size, self.splits = size, splits
        self.room, self.label_room = room, label_room  # (left, quota) of a split; of (label, split)
        self.n: dict = defaultdict(int)  # components on the arcs of splits and of (label, split)
        self.own: dict = {}  # bundle -> its cost by split
        self.at: dict = defaultdict(set)  # bundle -> splits with one more component
        self.heaps: dict = defaultdict(list)  # (label, from, to) -> (cost of the move, bundle)
        self.label: dict = {}

    def _growth(self, room: tuple[float, float], n: int, weight: float) -> float:
        left, quota = room[0] - n * self.size, room[1]
        return weight * (self.size * self.size - 2 * self.size * left) / quota

    def _move(self, label, a: str, b: str):
        """The cheapest bundle of a label with a component at split ``a`` and none at ``b``."""
        heap = self.heaps[label, a, b]
        while heap and not (a in self.at[heap[0][1]] and b not in self.at[heap[0][1]]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def _arcs(self):
        labels = sorted(set(self.label.values()), key=str)
        for s in self.splits:
            for lab in labels:
                node = (lab, s)
                yield node, s, self._growth(self.label_room[lab, s], self.n[node], 1.0), None
                if self.n[node]:
                    yield s, node, -self._growth(self.label_room[lab, s], self.n[node] - 1, 1.0), None
                for t in self.splits:
                    best = self._move(lab, s, t) if t != s else None
                    if best:
                        yield node, (lab, t), best[0], best[1]

    def place(self, bundle: int, label, own: dict[str, float]) -> None:
        """One more component of a bundle, along the cheapest path."""
        self.own[bundle], self.label[bundle] = own, label
        dist = {(label, s): own[s] for s in self.splits if s not in self.at[bundle]}
        back: dict = {node: (None, None) for node in dist}
        arcs = list(self._arcs())
        for _ in range(len(self.splits) * (len(set(self.label.values())) + 1)):
            changed = False
            for u, v, cost, moved in arcs:
                if u in dist and moved != bundle and dist[u] + cost < dist.get(v, math.inf) - 1e-9:
                    dist[v], back[v], changed = dist[u] + cost, (u, moved), True
            if not changed:
                break
        end = min(self.splits, key=lambda s: (dist.get(s, math.inf) + self._growth(self.room[s], self.n[s], 4.0), s))
        self.n[end] += 1
        node = end
        while node is not None:
            before, moved = back[node]
            if before is None:
                self._put(bundle, None, node[1])
            elif moved is not None:
                self._put(moved, before[1], node[1])
            elif isinstance(node, str):
                self.n[before] += 1
            else:
                self.n[node] -= 1
            node = before

    def _put(self, bundle: int, old: str | None, new: str) -> None:
        at = self.at[bundle]
        at.discard(old)
        at.add(new)
        for a in at:
            for b in self.splits:
                if b not in at:
                    heapq.heappush(self.heaps[self.label[bundle], a, b], (self.own[bundle][b] - self.own[bundle][a], bundle))


def deviation(bundles: list[tuple[int, tuple, int]], plan: list[dict[str, int]], shares: dict[str, float]) -> float:
    """The cost of a plan: squared deviations from the quotas of splits (four times) and of labels in splits, over the quotas."""
    total = sum(shares.values())
    cost = 0.0
    every = {lab for _, profile, _ in bundles for lab, _ in _whole(0, profile)} | {None}
    for s, share in shares.items():
        for lab in every:
            amounts = [(n, took[s], size if lab is None else dict(profile).get(lab, 0)) for (size, profile, n), took in zip(bundles, plan)]
            quota = max(sum(n * k for n, _, k in amounts) * share / total, 1e-9)
            cost += (4.0 if lab is None else 1.0) * (sum(t * k for _, t, k in amounts) - quota) ** 2 / quota
    return cost


def _whole(size: int, profile: tuple) -> list[tuple]:
    """A profile with the records that have no label, as a label of their own."""
    rest = size - sum(k for _, k in profile)
    return [*profile, ("", rest)] if rest > 1e-9 else list(profile)


def allocate(bundles: list[tuple[int, tuple, int]], shares: dict[str, float]) -> list[dict[str, int]]:
    """How many components of each bundle (size, label profile, number of components) go to each split, by min-cost flow.

    Sizes are solved in descending order. Every bundle of a size has a quota in each split: its components by what is left
    of the labels' quotas there. Their whole parts are taken; what is left over of all bundles of that size is rounded at
    once by a min-cost flow (``Rounding``) to the component above or below. Later sizes make up for what large components
    distort; at the end components move on as long as that lowers the whole deviation, and no bundle leaves its quotas by
    more than two components. Label totals are exact. Shares are normalised by their sum. Ties go by name.
    """
    total_share = sum(shares.values())
    names = sorted(n for n, s in shares.items() if s > 0)
    share = {s: shares[s] / total_share for s in names}
    labels: dict = defaultdict(float)
    for size, profile, n in bundles:
        for lab, k in _whole(size, profile):
            labels[lab] += k * n
    quota = {(lab, s): max(t * share[s], 1e-9) for lab, t in labels.items() for s in names}
    whole = {s: max(sum(labels.values()) * share[s], 1e-9) for s in names}
    left, rest = dict(quota), dict(whole)
    plan: list[dict[str, int]] = [dict.fromkeys(shares, 0) for _ in bundles]
    target: list[dict[str, float]] = [{} for _ in bundles]

    def give(i: int, s: str, n: int) -> None:
        size, profile, _ = bundles[i]
        plan[i][s] += n
        rest[s] -= size * n
        for lab, k in _whole(size, profile):
            left[lab, s] -= k * n

    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], str(bundles[i][1])))
    for size, group in itertools.groupby(order, key=lambda i: bundles[i][0]):
        group, over = list(group), []
        room = {lab: {s: max(left[lab, s], 0.0) for s in names} for lab in labels}
        for i in group:
            _, profile, n = bundles[i]
            part = dict.fromkeys(names, 0.0)
            for lab, k in _whole(size, profile):
                there = sum(room[lab].values())
                for s in names:
                    part[s] += k / size * (room[lab][s] / there if there > 1e-9 else share[s])
            target[i] = {s: n * part[s] for s in names}
        for i in group:
            for s in names:
                give(i, s, math.floor(target[i][s] + 1e-9))
            over.append(bundles[i][2] - sum(plan[i].values()))
        flow = Rounding(size, names, {s: (rest[s], whole[s]) for s in names}, {(lab, s): (left[lab, s], quota[lab, s]) for lab in labels for s in names})
        for i, n in zip(group, over):
            profile = _whole(size, bundles[i][1])
            main = max(profile, key=lambda p: (p[1], str(p[0])))[0]
            own = {}
            for s in names:
                frac = target[i][s] - math.floor(target[i][s] + 1e-9)
                others = sum((k * k - 2 * k * left[lab, s]) / quota[lab, s] for lab, k in profile if lab != main)
                own[s] = others + 1e-6 * (1 - 2 * frac)
            for _ in range(n):
                flow.place(i, main, own)
        for i in group:
            for s in sorted(flow.at[i]):
                give(i, s, 1)

    def change(i: int, a: str, b: str) -> float:
        size, profile, _ = bundles[i]
        parts = [(4.0, size, rest[a], whole[a], rest[b], whole[b])] + [(1.0, k, left[lab, a], quota[lab, a], left[lab, b], quota[lab, b]) for lab, k in _whole(size, profile)]
        return sum(w * ((2 * k * la + k * k) / qa + (k * k - 2 * k * lb) / qb) for w, k, la, qa, lb, qb in parts)

    moving = True
    while moving:
        moving = False
        for i in reversed(order):
            for a, b in itertools.permutations(names, 2):
                if plan[i][a] > max(0, target[i][a] - 2) and plan[i][b] < target[i][b] + 2 and change(i, a, b) < -1e-6:
                    give(i, a, -1)
                    give(i, b, 1)
                    moving = True
    return plan


def grouped_split(df: DataFrame, id_col: str, keys: list[str], shares: dict[str, float], label: str | None = None, seed: int = 7) -> DataFrame:
    """``id, grp, grp_size, split``: one row per id, all ids of a group in one split, the splits near their shares.

    Groups are bundled by size and label profile (exact counts of each value of ``label``; profiles are told apart by
    a hash of PROFILES values, so the driver sees at most that many bundles a size, with exact totals of each label);
    ``allocate`` plans whole bundles on the driver, and the members of a bundle take the planned splits by the rank of
    their hash. No list of groups leaves the executors.

    NULL ids are left out; NULL keys link nothing; of several rows of an id the smallest non-NULL label counts. A group
    larger than any quota goes where it deviates least. Empty table: no rows. Deterministic in ``seed``.
    """
    members = group_keys(df, id_col, keys)
    if label:
        lab = only(df, id_col, label).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label}`").cast("string")).alias("lab"))
        members = members.join(lab, "id")
    else:
        members = members.withColumn("lab", F.lit(None).cast("string"))
    by_label = members.groupBy("grp", "lab").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(F.col("lab"), F.col("n").alias("k"))
    groups = by_label.groupBy("grp").agg(F.sum("n").alias("grp_size"), F.array_sort(F.collect_list(F.when(F.col("lab").isNotNull(), one))).alias("profile"))
    groups = cut(groups.withColumn("bundle", F.pmod(F.xxhash64("profile"), F.lit(PROFILES)).cast("int")))
    counts = groups.groupBy("grp_size", "bundle").agg(F.count(F.lit(1)).alias("n"))
    totals = groups.select("grp_size", "bundle", F.inline("profile")).groupBy("grp_size", "bundle", "lab").agg(F.sum("k").alias("k"))
    totals = totals.groupBy("grp_size", "bundle").agg(F.array_sort(F.collect_list(F.struct("lab", "k"))).alias("labels"))
    found = counts.join(totals, ["grp_size", "bundle"], "left").orderBy("grp_size", "bundle").collect()
    bundles = [(r["grp_size"], tuple((p["lab"], p["k"] / r["n"]) for p in r["labels"] or []), r["n"]) for r in found]
    rows = []
    for r, took in zip(found, allocate(bundles, shares)):
        start = 0
        for s in sorted(took):
            if took[s]:
                rows.append((r["grp_size"], r["bundle"], s, start, start + took[s]))
                start += took[s]
    spark = df.sparkSession
    slots = spark.createDataFrame(rows, "grp_size long, bundle int, split string, lo long, hi long")
    h = F.xxhash64(F.lit(seed), "grp")
    at = groups.drop("profile").withColumn("h", h)
    at = ranked(at, ["grp_size", "bundle"], [F.col("h"), F.col("grp")], F.pmod(F.shiftright("h", 40), F.lit(partitions(spark))))
    placed = at.join(slots, ["grp_size", "bundle"]).where("rank0 >= lo AND rank0 < hi").select("grp", "grp_size", "split")
    return members.select("id", "grp").join(placed, "grp").select("id", "grp", "grp_size", "split")
