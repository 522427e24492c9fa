"""Embedding near-duplicates: exact threshold links by dual traversal of cover trees.

Vectors are compared within a label (and a dimension). On the unit sphere cosine >= t means a
distance of at most sqrt(2 - 2t). Equal vectors are merged first. The top of the tree is a
net of pivots chosen farthest first from a bounded sample; every vector is assigned to its
nearest pivot and each pivot's covering radius is the largest distance over all its vectors.
Pivot pairs that lie further apart than their radii and the threshold allow are pruned. What
is left is dealt out in blocks of bounded size; for each pair of blocks a task builds the
lower levels (nested nets, radii halved from level to level), traverses the two trees
together, prunes node pairs by the same bound and tests the remaining vectors in double
precision. A task returns a count of links per vector and the edges of a spanning forest,
never the pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label,
link with nothing; they and repeated rows keep their rows. Rows with equal vectors and labels
link with each other whatever their ids; null ids are counted as links and are the component
only where no other id is reachable. Columns named like added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import connected_components, other_columns, stored

ADDED = ("n_links", "component_id", "kept")
#: Vectors in one block; a task holds two blocks.
BLOCK = 2048
#: Vectors the pivots are chosen from, and the number of pivots (a bounded broadcast).
SAMPLE = 4096
PIVOTS = 64
_SLACK = 1e-9
_DENSE = 4096
_CHUNK = 1 << 17


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Tree:
    """Nested nets of a block: ``levels[l]`` are positions, ``up[l]`` their parents' ranks."""

    def __init__(self, x: np.ndarray):
        self.x = x
        apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
        n = len(x)
        everyone = np.arange(n)
        centre, rank = np.zeros(1, np.int64), np.zeros(n, np.int64)
        self.levels, self.children, owners = [centre], [], [np.zeros(n, np.int64)]
        width = 1.0
        while len(centre) < n:
            if width < 2**-6:
                chosen = everyone
            else:
                chosen = self._net(apart, centre, width)
            if len(chosen) > len(centre):
                # A new centre hangs below the node that holds it one level up.
                nearest = self._nearest(apart, owners[-1], chosen)
                parent = rank[chosen]
                order = np.argsort(parent, kind="stable")
                self.children.append((chosen[order], np.searchsorted(parent[order], np.arange(len(centre) + 1))))
                centre = chosen[order]
                place = np.full(n, -1)
                place[centre] = np.arange(len(centre))
                rank = place[nearest]
                owners.append(nearest)
                self.levels.append(centre)
            width /= 2
        self.radius = []
        for centre, owner in zip(self.levels, owners):
            far = np.zeros(n)
            np.maximum.at(far, owner, apart[everyone, owner])
            self.radius.append(far[centre])

    @staticmethod
    def _net(apart: np.ndarray, centre: np.ndarray, width: float) -> np.ndarray:
        free = (apart[centre] > width).all(axis=0)
        chosen = list(centre)
        while free.any():
            at = int(np.argmax(free))
            chosen.append(at)
            free &= apart[at] > width
            free[at] = False
        return np.array(chosen)

    @staticmethod
    def _nearest(apart: np.ndarray, owner: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Nearest chosen position that lies in the same node, so that the nets nest."""
        nearest = np.empty_like(owner)
        for node in np.unique(owner):
            members = np.flatnonzero(owner == node)
            inside = chosen[owner[chosen] == node]
            nearest[members] = inside[np.argmin(apart[np.ix_(members, inside)], axis=1)]
        return nearest

    def below(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the next level in the order of their parents, and where each begins."""
        return self.children[level]


def _traverse(a: _Tree, b: _Tree, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs at most ``limit`` apart."""
    ia = ib = np.zeros(1, np.int64)
    la = lb = 0
    while True:
        down_a, down_b = la < len(a.children), lb < len(b.children)
        if not (down_a or down_b):
            return a.levels[la][ia], b.levels[lb][ib]
        ka, sa = a.below(la) if down_a else (a.levels[la], np.arange(len(a.levels[la]) + 1))
        kb, sb = b.below(lb) if down_b else (b.levels[lb], np.arange(len(b.levels[lb]) + 1))
        la, lb = la + down_a, lb + down_b
        ra, rb = a.radius[la], b.radius[lb]
        na, nb = sa[ia + 1] - sa[ia], sb[ib + 1] - sb[ib]
        kept_a, kept_b = [], []
        dense = na * nb >= _DENSE
        for p, q in zip(ia[dense], ib[dense]):
            u, v = np.arange(sa[p], sa[p + 1]), np.arange(sb[q], sb[q + 1])
            apart = np.sqrt(np.maximum(0, 2 - 2 * (a.x[ka[u]] @ b.x[kb[v]].T)))
            i, j = np.nonzero(apart <= limit + _SLACK + ra[u][:, None] + rb[v][None, :])
            kept_a.append(u[i])
            kept_b.append(v[j])
        p, q, m, w = ia[~dense], ib[~dense], (na * nb)[~dense], nb[~dense]
        ends = np.cumsum(m)
        cuts = np.searchsorted(ends, np.arange(_CHUNK, (ends[-1] if len(ends) else 0) + _CHUNK, _CHUNK))
        low = 0
        for high in [*(cuts + 1), len(p)]:
            high = min(int(high), len(p))
            if high <= low:
                continue
            own = np.repeat(np.arange(low, high), m[low:high])
            k = np.arange(len(own)) - np.repeat(np.cumsum(m[low:high]) - m[low:high], m[low:high])
            u, v = sa[p[own]] + k // w[own], sb[q[own]] + k % w[own]
            dots = np.einsum("ij,ij->i", a.x[ka[u]], b.x[kb[v]])
            near = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= limit + _SLACK + ra[u] + rb[v]
            kept_a.append(u[near])
            kept_b.append(v[near])
            low = high
        ia = np.concatenate(kept_a) if kept_a else np.zeros(0, np.int64)
        ib = np.concatenate(kept_b) if kept_b else np.zeros(0, np.int64)


def block_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the pairs with at least this cosine; y None: within x, i < j."""
    tree = _Tree(x)
    other = tree if y is None else _Tree(y)
    i, j = _traverse(tree, other, float(np.sqrt(2 - 2 * cosine)))
    if y is None:
        i, j = i[i < j], j[i < j]
    exact = np.concatenate(
        [
            np.einsum("ij,ij->i", x[i[s : s + _CHUNK]], other.x[j[s : s + _CHUNK]]) >= cosine
            for s in range(0, max(1, len(i)), _CHUNK)
        ]
    )
    return i[exact], j[exact]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest first: each prefix is a net, with ever smaller radii."""
    chosen = [0]
    apart = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        apart = np.minimum(apart, 2 - 2 * (sample @ sample[chosen[-1]]))
        if apart.max() <= 0:
            break
        chosen.append(int(np.argmax(apart)))
    return sample[chosen]


def _assigned(classes: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``pivot`` and ``far``, the distance to it, per dimension of the vectors."""
    taken = classes.select("x").orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for row in taken:
        by_size.setdefault(len(row[0]), []).append(row[0])
    pivots = {size: _pivots(_unit(rows), PIVOTS) for size, rows in by_size.items()}

    def batches(found):
        for batch in found:
            n = batch.num_rows
            near, far = np.zeros(n, np.int32), np.full(n, 2.0)
            size = batch.column("dim").to_numpy()
            rows = batch.column("x")
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if d in pivots:
                    x = _unit(rows.take(pa.array(at)).flatten().to_numpy().reshape(-1, d))
                    dots = x @ pivots[d].T
                    near[at] = best = np.argmax(dots, axis=1)
                    far[at] = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(at)), best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "pivot", "far"]
            )

    schema = classes.withColumns({"pivot": F.lit(0), "far": F.lit(0.0)}).schema
    found = classes.mapInArrow(batches, schema)
    apart = [
        (size, i, j, float(d))
        for size, p in pivots.items()
        for (i, j), d in np.ndenumerate(np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T))))
    ]
    found.between = classes.sparkSession.createDataFrame(apart, "dim int, p int, q int, between double")
    return found


def _block_pairs(classes: DataFrame, between: DataFrame, limit: float, block: int) -> DataFrame:
    """``label, dim, p, pb, q, qb`` of the blocks that must be compared, p/pb up to q/qb."""
    nodes = classes.groupBy("label", "dim", "pivot").agg(
        F.max("far").alias("far"), F.ceil(F.count("*") / block).cast("int").alias("blocks")
    )
    left = nodes.select("label", "dim", F.col("pivot").alias("p"), F.col("far").alias("pf"), F.col("blocks").alias("pn"))
    right = nodes.select("label", "dim", F.col("pivot").alias("q"), F.col("far").alias("qf"), F.col("blocks").alias("qn"))
    pairs = left.join(right, ["label", "dim"]).where("p <= q")
    pairs = pairs.join(F.broadcast(between), ["dim", "p", "q"], "left")
    near = F.coalesce("between", F.lit(0.0)) <= F.col("pf") + F.col("qf") + (limit + _SLACK)
    pairs = pairs.where(near)
    pairs = pairs.withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)))
    pairs = pairs.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
    return pairs.where("p < q or pb <= qb").select("label", "dim", "p", "pn", "pb", "q", "qn", "qb")


def near_vectors(
    vectors: DataFrame,
    cosine: float,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """The vectors with ``n_links, component_id, kept``; 0 < cosine < 1."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = (
        (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    plain = vectors.select(
        F.col(vec_id).alias("id"), F.col(label).alias("label"), F.when(sound, x).alias("x")
    ).where("x is not null and label is not null")
    classes = plain.groupBy("label", "x").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stored(
        classes.select("*", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("class")), "vectors"
    )
    placed = _assigned(classes)
    between = placed.between
    placed = stored(placed, "placed")
    limit = float(np.sqrt(2 - 2 * cosine))
    pairs = _block_pairs(placed, between, limit, block)
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")

    blocks = placed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    members = placed.join(blocks, ["label", "dim", "pivot"])
    members = members.select(
        "label", "dim", "pivot", F.pmod(F.xxhash64("class"), F.col("n")).cast("int").alias("b"), "class", "copies", "x"
    )
    sides = pairs.select("label", "dim", F.col("p").alias("pivot"), F.col("pb").alias("b"), "pair", F.lit(0).alias("side"))
    sides = sides.unionByName(
        pairs.where("p <> q or pb <> qb").select(
            "label", "dim", F.col("q").alias("pivot"), F.col("qb").alias("b"), "pair", F.lit(1).alias("side")
        )
    )
    dealt = members.join(sides, ["label", "dim", "pivot", "b"]).select("pair", "side", "class", "copies", "x")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        rows = table.column("x").combine_chunks()
        x = _unit(rows.flatten().to_numpy().reshape(len(side), -1))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(two) and len(one):
            i, j = block_links(x[one], x[two], cosine)
            i, j = one[i], two[j]
        elif two.size:
            i = j = np.zeros(0, np.int64)
        else:
            i, j = block_links(x[one], None, cosine)
            i, j = one[i], one[j]
        n = len(side)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        at, up = _forest(i, j, n)
        some = np.flatnonzero(links)
        return pa.table(
            {
                "class": np.concatenate([ids[some], ids[at]]),
                "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(at), np.int64)]),
                "to": pa.array(
                    np.concatenate([np.zeros(len(some), np.int64), ids[up]]),
                    mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(at), bool)]),
                ),
            }
        )

    found = dealt.groupBy("pair").applyInArrow(compare, "class long, links long, to long")
    found = stored(found, "vector-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("to is not null"), "class", "to")
    named = classes.join(links, "class", "left").join(
        components.withColumnRenamed("node", "class"), "class", "left"
    )
    named = named.select(
        "label",
        "x",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "class").alias("component"),
        "first",
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "component").select(
        F.col("label").alias("__label"), F.col("x").alias("__x"), "links", "smallest"
    ).withColumnsRenamed({"links": "__links", "smallest": "__smallest"})
    rows = vectors.withColumns({"__x": F.when(sound, x), "__label": F.col(label)})
    rows = rows.join(named, ["__label", "__x"], "left")
    component = F.when(F.col("__links").isNull(), F.col(vec_id)).otherwise(F.col("__smallest"))
    return rows.select(
        *other_columns(vectors, *ADDED),
        F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col(vec_id).eqNullSafe(component)).alias("kept"),
    )
