"""Near-duplicates by SimHash, linked through vantage-point trees.

A document's 64-bit fingerprint has a bit set where over half of its word shingles' XXH64 hashes
(repeats included) have it. Equal fingerprints collapse to one node. A vantage-point tree deals the
nodes out: each node has one home shard, and where it lies within the radius of a boundary on the
inner side it also visits the outer shards; by the triangle inequality every pair within the radius
then meets in one shard, one of the two at home. The tree is drawn from a bounded hash sample, and
where the leaves would then hold more than a shard, each grows a tree of its own from a sample that
follows the input, one task a leaf; only the vantage points reach the driver. Shards with many
visitors are cut into pieces, each with all that are at home, so a task is bounded at any input. A
shard goes on splitting by vantage points in memory until small sets are left, which are compared
exactly. It returns one edge per node to the smallest node of its local group, never pairs. The
components of these edges are the groups.

A radius of a few bits is what the bounds can prune. :func:`keep_first` also takes a ``similarity``
instead: many short fingerprints, each with a tree and a small radius, then find what one with a large
radius would, and exact sets of shingles verify it; see :mod:`.jaccard_dedup`.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; texts
shorter than a shingle are hashed whole; repeated rows are returned as often as they occur; rows that
repeat a doc_id with another text are documents of their own; a row whose doc_id is null keeps its
fingerprint and joins its group, but names none (component_id is null where all rows of a group have
none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hash_sample, look_up, map_batches, materialise, pieces_of, raw_bytes, ship, spread

#: Fingerprints of the sample that shapes the tree, at most, and one in SAMPLE_OF at most where there are many.
SAMPLE, SAMPLE_OF = 32_768, 8
#: Nodes at home in a shard at least and at most, visitors of a piece of it, and nodes of a set compared directly.
LEAST, SHARD, VISITORS, SMALL = 2_000, 65_536, 400_000, 48
#: Sampled nodes for each leaf that a tree is to have.
LEAF_SAMPLE = 16


def fingerprint(text: bytes | None, size: int) -> int:
    """The SimHash of the ``size``-word shingles of a text's bytes, A-Z lower-cased."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64, len(words) - size + 1)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    set_bits = (2 * counts > len(hashes)).ravel()
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def _bit_tables():
    import numpy as np

    return np.arange(8, dtype=np.int64)[None, :] * 256, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


_PLACES, _BITS = _bit_tables()


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, print): every row's fingerprint as a signed 64-bit number, and a hash of its text."""

    def run(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in pieces_of(batch, "text", 16 << 20):
            prints = np.array([fingerprint(x, size) for x in raw_bytes(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(prints)], names=["doc_id", "text_key", "print"])

    given = spread(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("text_key", F.xxhash64("text"))
    return map_batches(given, run, "doc_id long, text_key long, print long")


def split(prints, rng):
    """(vantage, radius) that halves ``prints`` best of a few vantage points, or None if none does."""
    import numpy as np

    best, share = None, 0.0
    for vantage in prints[rng.integers(0, len(prints), 4)]:
        far = np.bitwise_count(prints ^ vantage)
        middle = int(np.median(far))
        for radius in (middle - 1, middle):
            inside = float((far <= radius).mean())
            if min(inside, 1 - inside) > share:
                best, share = (int(vantage), radius), min(inside, 1 - inside)
    return best if share >= 0.1 else None


def grow(prints, leaf: int, seed: int = 7) -> list:
    """A tree as rows (vantage, radius, inner, outer); a negative child -k - 1 is shard k."""
    import numpy as np

    rng, nodes, shards = np.random.default_rng(seed), [], 0
    todo = [(prints, None, 0)]
    while todo:
        some, parent, side = todo.pop()
        cut = split(some, rng) if len(some) > leaf else None
        if cut is None:
            child, shards = -shards - 1, shards + 1
        else:
            child = len(nodes)
            nodes.append([cut[0], cut[1], 0, 0])
            inside = np.bitwise_count(some ^ np.uint64(cut[0])) <= cut[1]
            todo += [(some[inside], child, 2), (some[~inside], child, 3)]
        if parent is not None:
            nodes[parent][side] = child
    return nodes


def route(nodes: list, prints, reach: int):
    """(row, shard, home) for every shard that a fingerprint lives in or visits."""
    import numpy as np

    rows, shards, homes = [], [], []
    todo = [(0 if nodes else -1, np.arange(len(prints)), np.ones(len(prints), bool))]
    while todo:
        child, row, home = todo.pop()
        if not len(row):
            continue
        if child < 0:
            rows.append(row)
            shards.append(np.full(len(row), -child - 1))
            homes.append(home)
            continue
        vantage, radius, inner, outer = nodes[child]
        far = np.bitwise_count(prints[row] ^ np.uint64(vantage)).astype(np.int64)
        inside = far <= radius
        go_in = np.where(home, inside, far <= radius + reach)
        go_out = np.where(home, far > radius - reach, far > radius - reach)
        todo.append((inner, row[go_in], home[go_in]))
        todo.append((outer, row[go_out], (home & ~inside)[go_out]))
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class Forest:
    """Groups of numbered rows; the smallest row of a group names it."""

    def __init__(self, n: int):
        import numpy as np

        self.up = np.arange(n)

    def join(self, a, b) -> None:
        import numpy as np

        up = self.up
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(up, high, low)

    def roots(self, rows):
        import numpy as np

        found = self.up[rows]
        while True:
            nxt = self.up[found]
            if np.array_equal(nxt, found):
                return found
            found = nxt


def link_within(prints, home, reach: int, small: int = SMALL, seed: int = 11) -> Forest:
    """The groups among one shard's fingerprints, home ones compared to home ones and visitors."""
    import numpy as np

    rng, forest = np.random.default_rng(seed), Forest(len(prints))
    todo = [(np.arange(len(prints)), home)]
    while todo:
        row, at_home = todo.pop()
        if not at_home.any() or len(row) < 2:
            continue
        own = row[at_home]
        cut = split(prints[own], rng) if len(own) > small else None
        if cut is None:
            for k in range(0, len(own), 256):
                near = np.bitwise_count(prints[own[k : k + 256]][:, None] ^ prints[row][None, :]) <= reach
                a, b = np.nonzero(near)
                forest.join(own[k + a], row[b])
            continue
        far = np.bitwise_count(prints[row] ^ np.uint64(cut[0])).astype(np.int64)
        inside = far <= cut[1]
        go_in = np.where(at_home, inside, far <= cut[1] + reach)
        go_out = far > cut[1] - reach
        todo.append((row[go_in], at_home[go_in]))
        todo.append((row[go_out], (at_home & ~inside)[go_out]))
    return forest


def graft(tree: list, leaves: dict[int, list]) -> tuple[list, list[tuple[int, int]]]:
    """``tree`` with some of its shards replaced by trees, and for each shard of the whole which one of which it was.

    A row of a tree ends with its two children; a negative child -k - 1 is shard k.
    """
    out, origin = [], []

    def child(leaf: int, own: list) -> int:
        if not own:
            origin.append((leaf, 0))
            return -len(origin)
        base = len(out)
        out.extend(own)
        for k, row in enumerate(own):
            new = list(row)
            for side in (-2, -1):
                if row[side] < 0:
                    origin.append((leaf, -row[side] - 1))
                    new[side] = -len(origin)
                else:
                    new[side] = row[side] + base
            out[base + k] = new
        return base

    out.extend(list(x) for x in tree)
    if not tree:
        child(0, leaves.get(0, []))
    for k in range(len(tree)):
        for side in (-2, -1):
            if tree[k][side] < 0:
                out[k][side] = child(-tree[k][side] - 1, leaves.get(-tree[k][side] - 1, []))
    return out, origin


def vantage_tree(nodes: DataFrame, count: int, each: int) -> list:
    """A tree over ``nodes`` (print) whose shards are home to about ``each``, whatever their number is.

    The driver draws the first tree from at most ``SAMPLE`` nodes. Where it has too few leaves for so many
    nodes, a sample of ``LEAF_SAMPLE`` nodes for each shard wanted goes to the leaves, each of which is a task.
    """
    import numpy as np

    sample = [x[0] for x in hash_sample(nodes, max(64, min(SAMPLE, count // SAMPLE_OF)), "print").select("print").collect()]
    drawn = np.array(sorted(sample), np.int64).view(np.uint64)
    tree = grow(drawn, max(LEAF_SAMPLE, len(drawn) * each // max(count, 1)))
    if count * LEAF_SAMPLE <= len(drawn) * each or len(drawn) == count:
        return tree
    held = nodes.sparkSession.sparkContext.broadcast(tree)

    def home(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        row, shard, own = route(held.value, batch.column("print").to_numpy().view(np.uint64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(shard[own], pa.int32()), batch.column("print").take(pa.array(row[own]))], names=["leaf", "print"])

    def split(table):
        import numpy as np
        import pyarrow as pa

        own = grow(np.sort(table.column("print").to_numpy()).view(np.uint64), LEAF_SAMPLE)
        flat = np.array([(np.uint64(v).view(np.int64), r, a, b) for v, r, a, b in own], np.int64).reshape(-1, 4)
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "tree": pa.array([flat.ravel().tolist()], pa.list_(pa.int64()))})

    some = hash_sample(nodes.select("print"), count // each * LEAF_SAMPLE, "print")
    grown = map_batches(some, home, "leaf int, print long").groupBy("leaf").applyInArrow(split, "leaf int, tree array<long>").collect()
    leaves = {x["leaf"]: [[int(np.int64(v).view(np.uint64)), r, a, b] for v, r, a, b in zip(*[iter(x["tree"])] * 4, strict=True)] for x in grown if x["tree"]}
    return graft(tree, leaves)[0]


def shard_edges(nodes: DataFrame, reach: int, each: int | None = None) -> DataFrame:
    """(a, b) edges among the distinct fingerprints of ``nodes`` (print) whose components are those of all close pairs."""
    spark = nodes.sparkSession
    count = nodes.count()
    each = each or max(LEAST, min(SHARD, count // (4 * spark.sparkContext.defaultParallelism)))
    ship(spark)
    tree = vantage_tree(nodes, count, each)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        row, shard, home = route(shared.value, batch.column("print").to_numpy().view(np.uint64), reach)
        yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(row)), pa.array(shard, pa.int32()), pa.array(home)], names=["print", "shard", "home"])

    dealt = materialise(map_batches(nodes.select("print"), deal, "print long, shard int, home boolean"), "dealt")
    # a number for each shard with more visitors than one task takes: fewer than there are shards
    crowded = {x["shard"]: -(-x["n"] // VISITORS) for x in dealt.where("not home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > VISITORS).collect()}
    if crowded:
        pieces = F.broadcast(spark.createDataFrame(list(crowded.items()), "shard int, pieces long"))
        cut = dealt.join(pieces, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
        own = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
        dealt = cut.withColumn("piece", F.explode(F.when(F.col("home"), own).otherwise(F.array(F.pmod(F.xxhash64("print"), F.col("pieces")))))).drop("pieces")
    else:
        dealt = dealt.withColumn("piece", F.lit(0).cast("long"))

    def link(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("print")
        prints = table.column("print").to_numpy()
        forest = link_within(prints.view(np.uint64), table.column("home").to_numpy(zero_copy_only=False), reach)
        root = forest.roots(np.arange(len(prints)))
        other = root != np.arange(len(prints))
        return pa.table({"a": prints[root[other]], "b": prints[other]})

    return dealt.groupBy("shard", "piece").applyInArrow(link, "a long, b long")


def name_groups(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, ``key``, …) with ``grp``, the smallest key reachable by ``edges``, and its smallest doc_id."""
    keys = materialise(rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "keys")
    labels = components(edges)
    named = materialise(keys.join(labels.withColumnRenamed("node", key), key, "left").withColumn("grp", F.coalesce("component", key)).drop("component"), "named")
    groups = materialise(named.groupBy("grp").agg(F.min("least").alias("component_id"), F.count("*").alias("n_keys")), "groups")
    told = materialise(look_up(named, groups, "grp", count="n_keys").select(key, "n_rows", "grp", "component_id"), "told")
    return look_up(rows, told, key)


def linked(docs: DataFrame, size: int, reach: int) -> DataFrame:
    """doc_id, text_key, print, grp and component_id of every row of ``docs``."""
    rows = materialise(fingerprints(docs, size), "prints")
    nodes = materialise(rows.select("print").distinct(), "nodes")
    return name_groups(rows, shard_edges(nodes, reach), "print")


def near_duplicates(docs: DataFrame, size: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``."""
    return linked(docs, size, reach).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = 3, reach: int = 2, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each group, that with the smallest doc_id and hash of its text; rows without doc_id stay.

    Groups are of fingerprints within ``reach`` bits or, with a ``similarity``, of sets of shingles that are so similar.
    """
    if similarity is None:
        return first_of(docs, linked(docs, size, reach))
    from . import jaccard_dedup

    return first_of(docs, jaccard_dedup.linked(docs, size, similarity))


def first_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of ``docs`` that names each group of ``rows`` (doc_id, text_key, grp, component_id); rows without doc_id stay."""
    rows = materialise(rows.where("doc_id = component_id").groupBy("grp", "doc_id", "text_key").agg(F.count("*").alias("n")), "heads")
    first = rows.groupBy("grp", "doc_id").agg(F.min("text_key").alias("text_key"))
    chosen = materialise(rows.join(first, ["grp", "doc_id", "text_key"], "left_semi").select("doc_id", "text_key", "n"), "chosen")
    same = lambda x: (docs["doc_id"].cast("long") == x["doc_id"]) & (F.xxhash64(docs["text"]) == x["text_key"])
    kept = docs.join(chosen, same(chosen), "left_semi")
    if not chosen.where("n > 1").isEmpty():
        # equal rows: one of them, chosen among these only
        once, often = chosen.where("n = 1"), chosen.where("n > 1")
        kept = docs.join(once, same(once), "left_semi").unionByName(docs.join(often, same(often), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.where("doc_id is null"))
