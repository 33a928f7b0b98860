"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one, turned by a fixed random rotation and split into blocks of
``width`` coordinates. A cosine of at least t is a squared distance of at most 2 - 2t; if every
block's part of it were larger than the block's proportional share, so would be the sum. Each linked
pair is therefore within the share in at least one block: every block is range-joined under its
share, and the union of the candidates is verified with the whole vectors.

For the range join of a block, a k-d tree per label deals the vectors out: each has one home shard,
and where it lies within the radius of a cut on the inner side it also visits the outer shards, so
every pair meets with one of the two at home. Cuts are on the block's coordinates, with its radius,
or on any other one, with that of the whole distance, whichever parts the vectors better. The tree
is drawn from a bounded hash sample; where its leaves would hold more than a shard, each grows a tree
of its own from a sample that follows the input, one task a leaf, and only cuts reach the driver. A
pair counts in the first block in which it is in range. A region so dense that no coordinate parts it
is dealt to tiles whose pairs are tasks of their own. Equal vectors are one class with a count. A
shard returns sums of links and one edge per vector to the smallest of its local group, never pairs.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose
label is null, links with nothing; vectors of other lengths never link; rows that repeat a vec_id
are links of each other if their vectors are; a row without vec_id counts as a link where a row that
has one holds the same vector, and else links with nothing;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hash_sample, look_up, map_batches, materialise, ship
from .simhash import Forest, graft

#: Coordinates of a block, vectors of a shard on average, and vectors of the sample at most.
WIDTH, SHARD, SAMPLE = 8, 3_000, 32_768
#: Sampled vectors of a leaf that may still be cut.
LEAF_SAMPLE = 32
_ROTATIONS: dict = {}


def rotation(size: int):
    """A fixed orthonormal matrix."""
    import numpy as np

    if size not in _ROTATIONS:
        _ROTATIONS[size] = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    return _ROTATIONS[size]


def turned(vectors):
    """Unit vectors, rotated; each row is computed alike whatever the other rows are."""
    import numpy as np

    # scaled first, so that very small or large components neither vanish nor overflow
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return unit, np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]))


def shares(size: int, least: float, width: int) -> list[tuple[int, int, float]]:
    """(first, end, budget of squared distance) of each block."""
    limit = (2 - 2 * least) * (1 + 1e-9) + 1e-12
    return [(a, min(a + width, size), limit * (min(a + width, size) - a) / size) for a in range(0, size, width)]


def grow(points, block: tuple[int, int, float], reach: float, each: int, share: float) -> tuple[list, list[int], list[bool]]:
    """(rows (axis, cut, radius, inner, outer), tiles of each leaf, whether more of a sample would cut it).

    ``points`` are turned vectors, a sample that is ``share`` of all; ``block`` is (first, end, budget), and
    ``reach`` the distance that no linked pair exceeds on any coordinate.
    """
    import numpy as np

    first, end, budget = block
    nodes, tiles, more = [], [], []
    todo = [(points, None, 0)]

    def best(some):
        spread = some.var(axis=0)
        found = []
        for axis, radius in ((first + int(spread[first:end].argmax()), budget**0.5), (int(spread.argmax()), reach)):
            at = some[:, axis]
            cut = float(np.median(at))
            band = float(((at > cut - radius) & (at <= cut + radius)).mean())
            if band <= 0.9 and not (at <= cut).all():
                found.append((band, axis, cut, radius))
        return min(found, default=None)

    while todo:
        some, parent, side = todo.pop()
        whole = len(some) / share
        enough = len(some) >= LEAF_SAMPLE
        cut = best(some) if whole > each and enough else None
        if cut is None:
            child = -len(tiles) - 1
            tiles.append(max(1, round(whole / (4 * each))))
            more.append(whole > each and not enough)
        else:
            child = len(nodes)
            nodes.append([*cut[1:], 0, 0])
            inside = some[:, cut[1]] <= cut[2]
            todo += [(some[inside], child, -2), (some[~inside], child, -1)]
        if parent is not None:
            nodes[parent][side] = child
    return nodes, tiles, more


def route(nodes: list, points, visits: bool = True):
    """(row, leaf, home) for every leaf that a point lives in or, with ``visits``, is near."""
    import numpy as np

    rows, leaves, homes = [], [], []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        child, row, home = todo.pop()
        if not len(row):
            continue
        if child < 0:
            rows.append(row)
            leaves.append(np.full(len(row), -child - 1))
            homes.append(home)
            continue
        axis, cut, radius, inner, outer = nodes[child]
        radius = radius * (1 + 1e-9) + 1e-12 if visits else 0.0
        at = points[row, axis]
        inside = at <= cut
        go_in = np.where(home, inside, at <= cut + radius)
        go_out = at > cut - radius
        todo.append((inner, row[go_in], home[go_in]))
        todo.append((outer, row[go_out], (home & ~inside)[go_out]))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def _by_kind(batch) -> Iterator:
    """(label, length, rows of the batch, their turned vectors)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
    groups: dict = {}
    for k, key in enumerate(zip(batch.column("label").to_pylist(), sizes.tolist(), strict=True)):
        groups.setdefault(key, []).append(k)
    for (label, size), rows in groups.items():
        taken = batch.take(pa.array(rows))
        yield label, size, taken, turned(taken.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64))[1]


def block_trees(classes: DataFrame, count: int, least: float, width: int, each: int) -> dict:
    """(rows, tiles of each leaf) of the tree for each label, length and block."""
    import numpy as np

    reach = (2 - 2 * least) ** 0.5 * (1 + 1e-9) + 1e-12
    drawn = sorted(hash_sample(classes, max(64, min(SAMPLE, count // 4)), "node").select("node", "label", "embedding").collect())
    by: dict = {}
    for x in drawn:
        by.setdefault((x["label"], len(x["embedding"])), []).append(x["embedding"])
    share = max(len(drawn), 1) / max(count, 1)
    trees, short = {}, {}
    for (label, size), some in by.items():
        points = turned(np.array(some, np.float64))[1]
        for k, block in enumerate(shares(size, least, width)):
            nodes, tiles, more = grow(points, block, reach, each, share)
            trees[label, size, k] = nodes, tiles
            if len(drawn) < count and (leaves := {leaf for leaf, x in enumerate(more) if x}):
                short[label, size, k] = leaves
    if not short:
        return trees
    held = classes.sparkSession.sparkContext.broadcast((trees, short))
    wanted = count // each * LEAF_SAMPLE
    part = min(1.0, 0.95 * wanted / count)

    def home(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        trees, short = held.value
        for label, size, taken, points in _by_kind(batch):
            for k in range(-(-size // width)):
                if (label, size, k) in short:
                    row, leaf, own = route(trees[label, size, k][0], points, False)
                    some = np.flatnonzero(own & np.isin(leaf, list(short[label, size, k])))
                    names = [f"{size}:{k}:{x}" for x in leaf[some].tolist()]
                    yield pa.RecordBatch.from_arrays([taken.column("label").take(pa.array(row[some])), pa.array(names, pa.string()), taken.column("embedding").take(pa.array(row[some]))], names=["label", "leaf", "embedding"])

    def split(table):
        import json

        import numpy as np
        import pyarrow as pa

        size, k, _ = map(int, table.column("leaf")[0].as_py().split(":"))
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        points = turned(vectors)[1]
        points = points[np.lexsort(points.T)]
        nodes, tiles, _ = grow(points, shares(size, least, width)[k], reach, each, part)
        return pa.table({"label": table.column("label").slice(0, 1), "leaf": table.column("leaf").slice(0, 1), "tree": pa.array([json.dumps([nodes, tiles])])})

    some = hash_sample(classes.select("label", "embedding", "node"), wanted, "node")
    grown: dict = {}
    for x in map_batches(some, home, "label string, leaf string, embedding array<double>").groupBy("label", "leaf").applyInArrow(split, "label string, leaf string, tree string").collect():
        import json

        size, k, leaf = map(int, x["leaf"].split(":"))
        grown.setdefault((x["label"], size, k), {})[leaf] = json.loads(x["tree"])
    for key, leaves in grown.items():
        nodes, tiles = trees[key]
        whole, origin = graft(nodes, {leaf: x[0] for leaf, x in leaves.items()})
        trees[key] = whole, [leaves[leaf][1][k] if leaf in leaves else tiles[leaf] for leaf, k in origin]
    return trees


def tree_links(vectors, home, tile, pair, block: int, counts, least: float, width: int):
    """(links, forest) among a shard's vectors: home ones against all, each pair in its first block."""
    import numpy as np

    unit, points = turned(vectors)
    parts = shares(vectors.shape[1], least, width)
    first, end, budget = parts[block]
    order = np.argsort(~home, kind="stable")
    unit, points, tile, counts = unit[order], points[order], tile[order], counts[order]
    own = int(home.sum())
    inner = points[:, first:end]
    norms = (inner * inner).sum(axis=1)
    links, forest = np.zeros(len(order), np.int64), Forest(len(order))
    for k in range(0, own, 512):
        stop = min(k + 512, own)
        near = norms[k:stop, None] + norms[None, :] - 2 * inner[k:stop] @ inner.T <= budget + 1e-9
        near &= np.arange(len(order))[None, :] > np.arange(k, stop)[:, None]
        if pair[0] != pair[1]:
            near &= tile[k:stop, None] != tile[None, :]
        a, b = np.nonzero(near)
        a += k
        for s in range(0, len(a), 50_000):
            i, j = a[s : s + 50_000], b[s : s + 50_000]
            close = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            i, j = i[close], j[close]
            apart = (points[i] - points[j]) ** 2
            here = apart[:, first:end].sum(axis=1) <= budget
            for x, y, part in parts[:block]:
                here &= apart[:, x:y].sum(axis=1) > part
            i, j = i[here], j[here]
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            forest.join(i, j)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return links[back], order[forest.roots(np.arange(len(order)))][back]


def is_valid() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(node, label, embedding, n): distinct valid vectors of a label, named by their smallest vec_id."""
    return vectors.where(is_valid()).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).where("node is not null")


def near_duplicates(table: DataFrame, least: float = 0.93, width: int = WIDTH, each: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    vectors = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    classes = materialise(classes_of(vectors), "classes")
    ship(spark)
    held = spark.sparkContext.broadcast(block_trees(classes, classes.count(), least, width, each))

    def deal(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for label, size, taken, points in _by_kind(batch):
            node = taken.column("node").to_numpy()
            for k in range(-(-size // width)):
                nodes, tiles = held.value.get((label, size, k), ([], [1]))
                row, leaf, home = route(nodes, points)
                many = np.array(tiles)[leaf]
                tile = (node[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % many
                again = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, leaf, home, tile = (np.repeat(x, many) for x in (row, leaf, home, tile))
                names = [f"{size}:{k}:{x}:{min(t, u)}:{max(t, u)}" for x, t, u in zip(leaf.tolist(), tile.tolist(), again.tolist(), strict=True)]
                picked = taken.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([picked.column("label"), pa.array(names, pa.string()), pa.array(home), pa.array(tile), picked.column("node"), picked.column("n"), picked.column("embedding")], names=["label", "shard", "home", "tile", "node", "n", "embedding"])

    def link(data):
        import numpy as np
        import pyarrow as pa

        data = data.sort_by("node")
        size, block, _, low, high = map(int, data.column("shard")[0].as_py().split(":"))
        node = data.column("node").to_numpy()
        values = data.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        links, root = tree_links(values, data.column("home").to_numpy(zero_copy_only=False), data.column("tile").to_numpy(), (low, high), block, data.column("n").to_numpy(), least, width)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[np.minimum(root, len(node) - 1)][some]})

    dealt = map_batches(classes, deal, "label string, shard string, home boolean, tile long, node long, n long, embedding array<double>")
    found = materialise(dealt.groupBy("label", "shard").applyInArrow(link, "node long, links long, root long"), "links")
    labels = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")), "groups")
    sums = materialise(found.groupBy("node").agg(F.sum("links").alias("links")), "sums")
    named = classes.join(sums, "node", "left").join(labels, "node", "left")
    links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    named = materialise(named.select("label", "embedding", F.col("n").alias("n_rows"), links, F.coalesce("component", "node").alias("component")), "named")
    # vectors that link with nothing, or are a class without any vec_id, name themselves
    apart = vectors.where(~is_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    nameless = vectors.where(is_valid() & F.col("vec_id").isNull()).join(classes.select("label", "embedding"), ["label", "embedding"], "left_anti").select("vec_id", F.lit(0).cast("long"), "vec_id")
    found = look_up(vectors.where(is_valid()), named, "label", "embedding").select("vec_id", "n_links", "component").union(apart).union(nameless)
    return found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
