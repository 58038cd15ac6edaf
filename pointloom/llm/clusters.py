"""Clusters of mutually similar records: mergeable cluster-feature trees, Ward over their leaves, one assignment pass."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.graph import components
from pointloom.runtime import cut, only, partitions

#: Branching of a tree; side of the cells, in the first three numbers of a vector, that have a tree of their own; members of
#: a block of pairs; members that stand for a block.
BRANCH, CELL, BLOCK, STAND = 16, 16.0, 512, 8


class CFTree:
    """A cluster-feature tree: entries (n, linear sum, squared sum).

    An entry is absorbed by the nearest leaf while that leaf's radius stays within the threshold and the two centres are at
    most twice the threshold apart, so a large leaf takes in nothing far off. The threshold never grows: the number of
    leaves is bounded by the extent of what a tree sees, which is one cell.
    """

    def __init__(self, dims: int, threshold: float):
        self.dims, self.threshold = dims, threshold
        self.root = self._node(True)

    def _node(self, leaf: bool) -> dict:
        return {"leaf": leaf, "n": np.zeros(0), "ls": np.zeros((0, self.dims)), "ss": np.zeros(0), "kids": []}

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        halves = self._insert(self.root, n, ls, ss)
        if halves:
            self.root = self._node(False)
            for h in halves:
                self._append(self.root, h["n"].sum(), h["ls"].sum(0), h["ss"].sum(), h)

    def _append(self, node: dict, n: float, ls: np.ndarray, ss: float, kid: dict | None = None) -> None:
        node["n"], node["ls"], node["ss"] = np.append(node["n"], n), np.vstack([node["ls"], ls]), np.append(node["ss"], ss)
        if kid is not None:
            node["kids"].append(kid)

    def _insert(self, node: dict, n: float, ls: np.ndarray, ss: float):
        if len(node["n"]):
            gaps = (((node["ls"] / node["n"][:, None]) - ls / n) ** 2).sum(1)
            i = int(gaps.argmin())
            if node["leaf"]:
                m, s, q = node["n"][i] + n, node["ls"][i] + ls, node["ss"][i] + ss
                if q / m - ((s / m) ** 2).sum() <= self.threshold**2 and gaps[i] <= 4 * self.threshold**2:
                    node["n"][i], node["ls"][i], node["ss"][i] = m, s, q
                    return None
            else:
                halves = self._insert(node["kids"][i], n, ls, ss)
                if not halves:
                    node["n"][i] += n
                    node["ls"][i] += ls
                    node["ss"][i] += ss
                    return None
                keep = [j for j in range(len(node["kids"])) if j != i]
                node["n"], node["ls"], node["ss"] = node["n"][keep], node["ls"][keep], node["ss"][keep]
                node["kids"] = [node["kids"][j] for j in keep]
                for h in halves:
                    self._append(node, h["n"].sum(), h["ls"].sum(0), h["ss"].sum(), h)
                return self._split(node) if len(node["n"]) > BRANCH else None
        self._append(node, n, ls, ss)
        return self._split(node) if len(node["n"]) > BRANCH else None

    def _split(self, node: dict) -> list[dict]:
        c = node["ls"] / node["n"][:, None]
        d = ((c[:, None] - c[None]) ** 2).sum(2)
        a, b = np.unravel_index(d.argmax(), d.shape)
        to_b = d[:, b] < d[:, a]
        to_b[b], to_b[a] = True, False
        out = []
        for side in (~to_b, to_b):
            h = self._node(node["leaf"])
            h["n"], h["ls"], h["ss"] = node["n"][side], node["ls"][side], node["ss"][side]
            h["kids"] = [k for k, s in zip(node["kids"], side) if s]
            out.append(h)
        return out

    def leaves(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node["leaf"]:
                yield from zip(node["n"], node["ls"], node["ss"])
            stack += node["kids"]


def ward(n: np.ndarray, centres: np.ndarray, limit: float) -> np.ndarray:
    """Labels of weighted points after Ward agglomeration: the cheapest merge first, until its distance exceeds ``limit``."""
    m = len(n)
    label, n, c, live = np.arange(m), n.astype(float).copy(), centres.copy(), np.ones(m, bool)
    if m < 2:
        return label
    cost = 2 * n[:, None] * n[None] / (n[:, None] + n[None]) * ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    nearest = cost.argmin(1)
    best = cost[np.arange(m), nearest]
    while True:
        a = int(best.argmin())
        if not best[a] <= limit**2:
            return label
        b = int(nearest[a])
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        live[b], label[label == b] = False, a
        row = np.where(live, 2 * n[a] * n / (n[a] + n) * ((c - c[a]) ** 2).sum(1), np.inf)
        row[a] = np.inf
        cost[a], cost[:, a], cost[b], cost[:, b] = row, row, np.inf, np.inf
        best[b] = np.inf
        for i in np.flatnonzero(live & ((nearest == a) | (nearest == b) | (row < best))):
            nearest[i] = cost[i].argmin()
            best[i] = cost[i, nearest[i]]
        nearest[a] = row.argmin()
        best[a] = row[nearest[a]]


def _summaries(pdf: pd.DataFrame, dims: int, threshold: float) -> pd.DataFrame:
    """The leaves of one tree per key and cell over the rows (key, cell, n, ls, ss)."""
    trees: dict = {}
    for key, cell, n, ls, ss in zip(pdf["key"], pdf["cell"], pdf["n"], pdf["ls"], pdf["ss"]):
        tree = trees.get((key, cell))
        if tree is None:
            tree = trees[key, cell] = CFTree(dims, threshold)
        tree.add(n, np.asarray(ls, float), ss)
    rows = [(*k, float(n), ls.tolist(), float(ss)) for k, t in trees.items() for n, ls, ss in t.leaves()]
    return pd.DataFrame(rows, columns=["key", "cell", "n", "ls", "ss"])


def _agglomerate(pdf: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Ward over the entries (key, cell, n, ls, ...) of each key and cell."""
    out = []
    for (key, _), g in pdf.groupby(["key", "cell"], sort=True):
        n, ls = g["n"].to_numpy(), np.stack(g["ls"].to_numpy())
        label = ward(n, ls / n[:, None], limit)
        for lab in np.unique(label):
            own = label == lab
            out.append((key, float(n[own].sum()), ls[own].sum(0).tolist()))
    return pd.DataFrame(out, columns=["key", "n", "ls"])


def cell_of(vec: Column, border: float = 0.0) -> Column:
    """The cell of a vector by its first three numbers. With ``border``, a share of the side, a number nearer than that to a
    border of the cells takes the cell of a grid shifted by half a side instead."""
    parts = []
    for i in range(3):
        at = vec[i] / CELL
        own = F.floor(at).cast("string")
        off = at - F.floor(at)
        parts.append(F.when((off < border) | (off > 1 - border), F.concat(F.lit("s"), F.floor(at + 0.5).cast("string"))).otherwise(own) if border else own)
    return F.concat_ws("_", *parts)


def centres(vectors: DataFrame, dims: int, threshold: float, limit: float) -> DataFrame:
    """``key, cid, n, centre``: the clusters of every key of ``vectors (key, vec array<double>)``.

    One cluster-feature tree per key, cell and partition; their leaves are reduced in two steps (a group of partitions,
    then all), each by trees of the same kind. The leaves of a cell are agglomerated by Ward; the clusters so found are
    agglomerated twice more in cells that are shifted where a cluster is near a border, which joins what it parted (twice,
    with two widths, for those near the width itself). Rows are never gathered, and a key with a third of them is many cells.
    """
    spark = vectors.sparkSession
    wide = max(2, math.isqrt(partitions(spark)))
    buckets = 4 * partitions(spark)
    key_kind = vectors.schema["key"].dataType.simpleString()
    kind = f"key {key_kind}, cell string, n double, ls array<double>, ss double"

    def local(batches):
        trees: dict = {}
        for pdf in batches:
            for key, cell, v in zip(pdf["key"], pdf["cell"], pdf["vec"]):
                v = np.asarray(v, float)
                tree = trees.get((key, cell))
                if tree is None:
                    tree = trees[key, cell] = CFTree(dims, threshold)
                tree.add(1.0, v, float(v @ v))
        rows = [(*k, float(n), ls.tolist(), float(ss)) for k, t in trees.items() for n, ls, ss in t.leaves()]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "cell", "n", "ls", "ss"])

    leaves = vectors.select("key", cell_of(F.col("vec")).alias("cell"), "vec").mapInPandas(local, kind)
    bucket = F.pmod(F.xxhash64("key", "cell"), F.lit(buckets)).alias("_b")
    first = leaves.withColumn("_g", F.spark_partition_id() % wide).groupBy("_g", bucket).applyInPandas(lambda pdf: _summaries(pdf, dims, threshold), kind)
    merged = f"key {key_kind}, n double, ls array<double>"
    once = first.groupBy(bucket).applyInPandas(lambda pdf: _agglomerate(_summaries(pdf, dims, threshold), limit), merged)
    mean = F.transform("ls", lambda v: v / F.col("n"))
    for border in (0.25, 0.125):
        once = once.withColumn("cell", cell_of(mean, border)).groupBy(bucket).applyInPandas(lambda pdf: _agglomerate(pdf, limit), merged)
    return cut(once.select("key", F.xxhash64("key", "n", "ls").alias("cid"), "n", mean.alias("centre")))


def assign(rows: DataFrame, centre_table: DataFrame, slack: float = 0.0, per_task: int = 20_000) -> DataFrame:
    """The full assignment pass: all columns of ``rows (key, vec, ...)`` and ``cid, distance, home``.

    Each row comes out with its nearest centre of its key (``home`` true) and once more with every other centre that is
    not farther than the nearest by more than ``slack``. A centre is shown to the 27 cells around its own, so a row sees
    all that are within a cell's side; its own cluster's is always among them, as means stay in their cells. Buckets of
    cells with many rows are salted, their few centres repeated for each salt.
    """
    spark = rows.sparkSession
    buckets = 4 * partitions(spark)
    rows = rows.withColumn("_cell", cell_of(F.col("vec")))
    around = centre_table.select("key", "cid", "centre")
    for i in range(3):
        at = F.floor(F.col("centre")[i] / CELL)
        around = around.withColumn(f"_c{i}", F.explode(F.sequence(at - 1, at + 1)))
    around = around.select("key", F.concat_ws("_", *[F.col(f"_c{i}").cast("string") for i in range(3)]).alias("_cell"), "cid", "centre")
    b = F.pmod(F.xxhash64("key", "_cell"), F.lit(buckets)).cast("int")
    counts = {r["_b"]: r["count"] for r in rows.groupBy(b.alias("_b")).count().collect()}  # at most ``buckets`` rows
    salts = spark.createDataFrame([(k, max(1, -(-n // per_task))) for k, n in counts.items()] or [(0, 1)], "_b int, _s int")
    left = rows.withColumn("_b", b).join(F.broadcast(salts), "_b").withColumn("_salt", F.pmod(F.xxhash64("vec"), F.col("_s")).cast("int")).drop("_s")
    right = around.withColumn("_b", b).join(F.broadcast(salts), "_b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    names = [c for c in rows.columns if c != "_cell"]

    def meet(pdf: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        table = {k: (g["cid"].to_numpy(), np.stack(g["centre"].to_numpy())) for k, g in cs.groupby(["key", "_cell"])}
        out = []
        for key, g in pdf.groupby(["key", "_cell"]):
            cids, c = table[key]
            v = np.stack(g["vec"].to_numpy())
            d = np.sqrt(((v[:, None] - c[None]) ** 2).sum(2)) if len(v) * len(c) < 2_000_000 else np.stack([np.sqrt(((c - x) ** 2).sum(1)) for x in v])
            near = d.argmin(1)
            i, j = np.nonzero(d <= d[np.arange(len(v)), near][:, None] + slack)
            got = g[names].iloc[i].copy()
            got["cid"], got["distance"], got["home"] = cids[j], d[i, j], near[i] == j
            out.append(got[got["home"] | (slack > 0)])
        return pd.concat(out) if out else pd.DataFrame(columns=[*names, "cid", "distance", "home"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_cell") + ", cid long, distance double, home boolean"
    return left.groupBy("_b", "_salt").cogroup(right.groupBy("_b", "_salt")).applyInPandas(meet, kind)


def plane_vectors(planes: DataFrame, angle_deg: float, distance: float) -> DataFrame:
    """``plane_id, key (file), vec, unit, centroid, idx`` of the planes with a normal and a centroid.

    The vector has nine numbers: the centroid in units of ``distance``, and the normal's products with itself, so that
    sign and length don't matter, in units of their difference at ``angle_deg``. Two similar planes are within 1 of each
    other in either part. Of repeated rows of a plane one counts, the greatest by its values. NULL, zero, non-finite or
    short normals and centroids leave a plane out; NULL indices count as none.
    """
    p = only(planes, "plane_id", "file_id", "point_indices", "normal", "centroid").where("plane_id IS NOT NULL AND file_id IS NOT NULL")
    p = p.groupBy("plane_id").agg(F.max(F.struct("file_id", "normal", "centroid", "point_indices")).alias("p")).select("plane_id", "p.*")
    p = p.where("size(normal) = 3 AND size(centroid) = 3")
    good = ~F.exists(F.concat("normal", "centroid"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length = F.sqrt(F.aggregate("normal", F.lit(0.0), lambda a, v: a + v * v))
    p = p.where(good).withColumn("_len", length).where("_len > 0").withColumn("unit", F.transform("normal", lambda v: v / F.col("_len")))
    x, y, z = (F.col("unit")[i] for i in range(3))
    s = 1 / (math.sqrt(2) * math.sin(math.radians(angle_deg)))
    r = math.sqrt(2)
    vec = F.array(*[F.col("centroid")[i] / distance for i in range(3)], *[v * s for v in (x * x, y * y, z * z, x * y * r, x * z * r, y * z * r)])
    idx = F.array_distinct(F.coalesce(F.filter("point_indices", lambda i: i.isNotNull()), F.array().cast("array<int>")))
    return cut(p.select("plane_id", F.col("file_id").alias("key"), vec.alias("vec"), "unit", "centroid", idx.alias("idx")))


def plane_clusters(planes: DataFrame, angle_deg: float, distance: float, threshold: float = 0.5, limit: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The vectors of planes and the cluster centres of every file."""
    vectors = plane_vectors(planes, angle_deg, distance)
    return vectors, centres(vectors, 9, threshold, limit)


def describe(vectors: DataFrame, centre_table: DataFrame, typical: int = 3) -> DataFrame:
    """``key, cid, size, spread, typical``: each cluster by size, mean distance to the centre and its most central members.

    Members are ranked by distance, ties by the smaller id; a partial top-k comes before the shuffle.
    """
    a = assign(vectors.select("plane_id", "key", "vec"), centre_table).drop("vec", "home")
    sizes = a.groupBy("key", "cid").agg(F.count(F.lit(1)).alias("size"), F.avg("distance").alias("spread"))
    rank = F.row_number().over(Window.partitionBy("key", "cid").orderBy("distance", "plane_id"))
    top = a.withColumn("r", rank).where(F.col("r") <= typical)
    top = top.groupBy("key", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "plane_id"))), lambda t: t["plane_id"]).alias("typical"))
    return sizes.join(top, ["key", "cid"])


def _links(a: pd.DataFrame, b: pd.DataFrame, same: bool, angle: float, distance: float, overlap: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between two blocks of one cluster: pairs that are already connected, here or by
    their ``label`` where rows have one, aren't tested."""
    both = a if same else pd.concat([a, b])
    group = both["label"].to_numpy() if "label" in both else both["plane_id"].to_numpy()
    name = {g: i for i, g in enumerate(dict.fromkeys(group))}
    label = np.array([name[g] for g in group])
    la, lb = label[: len(a)], label if same else label[len(a) :]
    out = []
    ua, ub = np.stack(a["unit"].to_numpy()), np.stack(b["unit"].to_numpy())
    ca, cb = np.stack(a["centroid"].to_numpy()), np.stack(b["centroid"].to_numpy())
    ha, hb = a["home"].to_numpy(), b["home"].to_numpy()
    sa, sb = [frozenset(map(int, x)) for x in a["idx"]], [frozenset(map(int, x)) for x in b["idx"]]
    ia, ib = a["plane_id"].to_numpy(), b["plane_id"].to_numpy()
    for i in range(len(a)):
        ok = (((cb - ca[i]) ** 2).sum(1) < distance * distance) & (ha[i] | hb) & (lb != la[i])
        if same:
            ok[: i + 1] = False
        js = np.flatnonzero(ok)
        if not len(js):
            continue
        # The angle is compared by its sine where it is small: a cosine near 1 has too few digits.
        near = ub[js]
        js = js[np.arctan2(np.sqrt((np.cross(near, ua[i]) ** 2).sum(1)), np.abs(near @ ua[i])) < angle]
        for j in js:
            if la[i] != lb[j]:
                shared = len(sa[i] & sb[j])
                if shared and shared >= overlap * (len(sa[i]) + len(sb[j]) - shared):
                    old, new = lb[j], la[i]
                    label[label == old] = new  # la and lb are views of it
                    out.append((int(ia[i]), int(ib[j])))
    return out


def similar_groups(planes: DataFrame, angle_deg: float, distance: float, overlap: float) -> DataFrame:
    """``plane_id, cluster_id``: planes connected by similar pairs of one file, by the smallest plane of their group.

    Candidates come from the clusters: every plane goes to its cluster and to each other cluster of the file that is at
    most sqrt(2) farther, as two similar planes are within sqrt(2) of each other; the one nearer to its own centre
    therefore always meets the other there, so no similar pair is lost. Within a cluster the exact test (angle, distance,
    shared indices of all different ones) decides; only a spanning forest of links leaves a task.

    A cluster of more than BLOCK planes is cut into hash blocks. Each is connected within; a few members that stand for the
    largest group of each block connect the blocks. After that most planes of a hot cluster are one group, and only the
    others are shown to the other blocks, where they meet what they are not connected with. So rows are copied for what
    the groups leave over, not for all pairs of blocks.
    """
    vectors, centre_table = plane_clusters(planes, angle_deg, distance)
    spark = planes.sparkSession
    placed = assign(vectors, centre_table, slack=math.sqrt(2) * (1 + 1e-9)).drop("vec", "distance")
    placed = cut(placed)
    sizes = placed.groupBy("key", "cid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = placed.join(sizes, ["key", "cid"]).withColumn("k", F.ceil(F.col("_n") / BLOCK).cast("int")).drop("_n")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("plane_id"), F.col("k")).cast("int"))
    many = sizes.where(F.col("_n") > BLOCK)
    limit, far = math.radians(angle_deg), distance
    tasks = 16 * partitions(spark)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["key", "cid", "i"]):
            if len(g) > 1:
                out += _links(g, g, True, limit, far, overlap)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def connected(blocks: DataFrame) -> DataFrame:
        return blocks.groupBy(F.pmod(F.xxhash64("key", "cid", "i"), F.lit(tasks)).alias("_task")).applyInPandas(within, "a long, b long")

    links = cut(connected(rows))
    if not many.isEmpty():
        hot = cut(rows.where("k > 1"))
        links = cut(links.unionByName(_between(hot, links, connected, limit, far, overlap, tasks)))
    return components(links).select(F.col("node").alias("plane_id"), F.col("component").alias("cluster_id"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the group that their links put them in so far."""
    return rows.join(components(links).select(F.col("node").alias("plane_id"), F.col("component").alias("_c")), "plane_id", "left").withColumn("label", F.coalesce("_c", "plane_id")).drop("_c")


def _between(hot: DataFrame, links: DataFrame, connected, limit: float, far: float, overlap: float, tasks: int) -> DataFrame:
    """The links between the blocks of clusters with several blocks."""
    at = cut(_labelled(hot, links))
    size = at.groupBy("key", "cid", "i", "label").agg(F.count(F.lit(1)).alias("_n"))
    largest = size.groupBy("key", "cid", "i").agg(F.max(F.struct("_n", "label")).alias("m")).select("key", "cid", "i", F.col("m.label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("key", "cid", "i").orderBy("plane_id"))
    stand = at.join(largest, ["key", "cid", "i", "label"]).withColumn("_r", rank).where(F.col("_r") <= STAND).drop("_r", "label")
    # Sixty-four neighbouring blocks at once, and again shifted by half of them, so the chain has no gap.
    chain = stand.withColumn("i", F.floor(F.col("i") / 64)).unionByName(stand.withColumn("i", F.floor((F.col("i") + 32) / 64) + 1_000_000))
    bridges = cut(connected(chain))
    at = cut(_labelled(hot, links.unionByName(bridges)))
    size = at.groupBy("key", "cid", "label").agg(F.count(F.lit(1)).alias("_n"))
    main = size.groupBy("key", "cid").agg(F.max(F.struct("_n", "label")).alias("m")).select("key", "cid", F.col("m.label").alias("main"))
    at = at.join(main, ["key", "cid"])
    guests = at.where("label <> main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("j <> i")
    both = at.withColumn("j", F.col("i")).withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).drop("main", "k")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["key", "cid", "j"]):
            a, b = g[g["guest"]], g[~g["guest"]]
            if len(a) and len(b):
                out += _links(a, b, False, limit, far, overlap)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    met = both.groupBy(F.pmod(F.xxhash64("key", "cid", "j"), F.lit(tasks)).alias("_task")).applyInPandas(visit, "a long, b long")
    return bridges.unionByName(met)
