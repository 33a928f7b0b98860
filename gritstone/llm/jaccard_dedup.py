"""Near-duplicates by SimHash at a wide angle, linked through vantage-point trees and verified exactly.

A document's set is that of the XXH64 hashes of its ``size``-word shingles. Documents with equal
sets collapse to one node. Unrelated SimHash fingerprints of 64 bits lie 32 ± 4 bits apart and sets of
similarity 0.8 up to some 20, so one tree with such a radius prunes nothing. A node therefore
has one long SimHash: ``WIDE`` bits, and ``TABLES`` fingerprints of ``BITS`` bits more. Each of these
has a vantage-point tree of its own with radius ``REACH``, which does prune: a node is at home in one
shard of each tree and visits those that its radius touches. Pairs that meet within the radius and
differ in at most ``WIDE_REACH`` of the ``WIDE`` bits are candidates. A shard returns one edge per node,
never pairs. The nodes of a component of all these edges are compared by their whole sets, so no pair
below the similarity is ever linked.

Bits of two sets of similarity 0.8 differ with probability 0.1515 at most (the angle between them over
pi). Such a pair is within the radius of no tree with probability 1.4e-6, and beyond ``WIDE_REACH`` with
1.3e-6; both fall fast above 0.8. Majorities of few shingles differ more often, so sets of at
most ``FEW`` take each shingle's hash in ``PARTS`` variants, as if they were that many shingles; those
from ``MANY`` on have a SimHash as they are, those between both, so any pair in reach shares a kind.
All these numbers are set for similarities of 0.8 and more; below, pairs are missed more often.

Shards with more rows than a task takes are cut into pieces, and each two pieces meet in a task. So are
components of very many nodes or very long sets, in tiles; so memory is bounded and no pair is left out.
The components of the verified edges are the groups.

Defined cases: null and blank texts are copies of each other; texts shorter than a shingle are
hashed whole; rows that repeat a doc_id with another text are documents of their own; rows without
doc_id are in no group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hash_sample, look_up, map_batches, materialise, partitions_for, pieces_of, raw_bytes, ship, spread
from .simhash import LEAF_SAMPLE, Forest, graft, grow, name_groups, route, split

#: Trees of a node, bits of its fingerprint in each, and the radius there; bits that all trees share, and how many may differ.
TABLES, BITS, REACH = 72, 20, 1
WIDE, WIDE_REACH = 128, 40
#: Sets of at most FEW hashes count as PARTS times as many; at least MANY count as they are; MANY <= 0.8 * FEW.
FEW, MANY, PARTS = 64, 50, 16
#: Nodes at home in a shard, rows of a piece of it, nodes of the sample that shapes the trees, and nodes compared directly.
SHARD, PIECE, SAMPLE, SMALL = 131_072, 1_048_576, 8_192, 64
#: Nodes of a tile, and hashes of all their sets, on average.
TILE, TILE_HASHES = 4_096, 4 << 20


def shingles(text: bytes | None, size: int):
    """The distinct hashes of the ``size``-word shingles of a text's bytes, A-Z lower-cased, in order."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.unique(np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64, len(words) - size + 1))


def _salts(n: int):
    import numpy as np

    return np.random.default_rng(17).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(hashes, salts):
    """One 64-bit number for each of ``hashes`` and ``salts``."""
    import numpy as np

    x = hashes[:, None] ^ salts[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORDS = -(-(WIDE + TABLES * BITS) // 64)
_SALTS, _VARIANTS = _salts(_WORDS + PARTS)[:_WORDS], _salts(_WORDS + PARTS)[_WORDS:]


def long_print(hashes) -> bytes:
    """The long SimHash of a set: its ``WIDE`` bits, then ``TABLES`` unsigned 32-bit numbers of ``BITS`` bits."""
    import numpy as np

    counts = np.zeros(_WORDS * 64, np.int64)
    for k in range(0, len(hashes), 255):
        bits = np.unpackbits(_mixed(hashes[k : k + 255], _SALTS).view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    ones = 2 * counts > len(hashes)
    tables = ones[WIDE : WIDE + TABLES * BITS].reshape(TABLES, BITS) @ (1 << np.arange(BITS))
    return np.packbits(ones[:WIDE]).tobytes() + tables.astype("<u4").tobytes()


def long_prints(hashes) -> list[bytes]:
    """The one or two long SimHashes of a set; see ``FEW`` and ``MANY``."""
    few = [long_print(_mixed(hashes, _VARIANTS).ravel())] if len(hashes) <= FEW else []
    return few + ([long_print(hashes)] if len(hashes) >= MANY else [])


def unpacked(column):
    """(wide, tables) of a column of long SimHashes: arrays of two unsigned 64-bit and ``TABLES`` 32-bit numbers a row."""
    import numpy as np

    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    wide = np.ascontiguousarray(rows[:, : WIDE // 8]).view(np.uint64)
    return wide, np.ascontiguousarray(rows[:, WIDE // 8 :]).view("<u4").astype(np.uint64)


def vantage_trees(nodes: DataFrame, count: int, each: int) -> list[list]:
    """A tree for each table over ``nodes`` (print) whose shards are home to about ``each``; as :func:`.simhash.vantage_tree`."""
    import numpy as np
    import pyarrow as pa

    if count <= each:
        return [[] for _ in range(TABLES)]
    drawn = sorted(bytes(x[0]) for x in hash_sample(nodes, min(SAMPLE, max(64, count // 8)), "print").collect())
    _, prints = unpacked(pa.array(drawn, pa.binary()))
    trees = [grow(prints[:, t], max(LEAF_SAMPLE, len(drawn) * each // count), t) for t in range(TABLES)]
    if count * LEAF_SAMPLE <= len(drawn) * each or len(drawn) == count:
        return trees
    held = nodes.sparkSession.sparkContext.broadcast(trees)

    def home(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        _, prints = unpacked(batch.column("print"))
        for t, tree in enumerate(held.value):
            row, shard, own = route(tree, prints[:, t], 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(own.sum()), t), pa.int32()), pa.array(shard[own], pa.int32()), pa.array(prints[row[own], t].astype(np.int64))], names=["tree", "leaf", "near"])

    def grown(table):
        import numpy as np
        import pyarrow as pa

        own = grow(np.sort(table.column("near").to_numpy()).astype(np.uint64), LEAF_SAMPLE)
        flat = np.array(own, np.int64).reshape(-1, 4)
        return pa.table({"tree": table.column("tree").slice(0, 1), "leaf": table.column("leaf").slice(0, 1), "rows": pa.array([flat.ravel().tolist()], pa.list_(pa.int64()))})

    some = hash_sample(nodes, count // each * LEAF_SAMPLE, "print")
    leaves = [{} for _ in trees]
    for x in map_batches(some, home, "tree int, leaf int, near long").groupBy("tree", "leaf").applyInArrow(grown, "tree int, leaf int, rows array<long>").collect():
        if x["rows"]:
            leaves[x["tree"]][x["leaf"]] = [list(r) for r in zip(*[iter(x["rows"])] * 4, strict=True)]
    return [graft(tree, own)[0] for tree, own in zip(trees, leaves, strict=True)]


def apart(a, b):
    """In how many bits the rows of two arrays of ``WIDE`` bits differ."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def link_crowd(prints, wide, forest, row) -> None:
    """Join the candidates among ``row``, whose fingerprints no vantage point parts, comparing few of them where most are alike."""
    import numpy as np

    group, left = forest.roots(row), np.ones(len(row), bool)
    group = np.unique(group, return_inverse=True)[1]
    while True:
        # who is left of the smallest group is compared to all others, until one group is left
        count = np.bincount(group[left], minlength=len(row))
        if np.count_nonzero(count) < 2:
            return
        one = np.flatnonzero(left & (group == np.where(count > 0, count, len(row) + 1).argmin()))[0]
        near = np.flatnonzero(left & (np.bitwise_count(prints[row] ^ prints[row[one]]) <= REACH))
        near = near[apart(wide[row[near]], wide[row[one]]) <= WIDE_REACH]
        forest.join(np.full(len(near), row[one]), row[near])
        group[np.isin(group, group[near])] = group[one]
        left[one] = False


def candidates_within(prints, wide, home, small: int | None = None, seed: int = 11) -> Forest:
    """The groups of candidates among one shard's nodes, home ones compared to home ones and visitors."""
    import numpy as np

    small = small or SMALL
    rng, forest = np.random.default_rng(seed), Forest(len(prints))
    todo = [(np.arange(len(prints)), home)]
    while todo:
        row, at_home = todo.pop()
        if not at_home.any() or len(row) < 2:
            continue
        own = row[at_home]
        if len(own) <= small:
            a, b = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[row][None, :]) <= REACH)
            good = (own[a] != row[b]) & (apart(wide[own[a]], wide[row[b]]) <= WIDE_REACH)
            forest.join(own[a[good]], row[b[good]])
            continue
        cut = split(prints[own], rng)
        if cut is not None:
            far = np.bitwise_count(prints[row] ^ prints.dtype.type(cut[0])).astype(np.int64)
            inside = far <= cut[1]
            go_in, go_out = np.where(at_home, inside, far <= cut[1] + REACH), far > cut[1] - REACH
        if cut is None or go_in.sum() + go_out.sum() > 1.8 * len(row):
            link_crowd(prints, wide, forest, row)
            continue
        todo.append((row[go_in], at_home[go_in]))
        todo.append((row[go_out], (at_home & ~inside)[go_out]))
    return forest


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b) edges among the ``WIDE`` bits of ``nodes`` (print) whose components hold all pairs that are candidates."""
    spark, count = nodes.sparkSession, nodes.count()
    ship(spark)
    trees = vantage_trees(nodes, count, SHARD)
    shared = spark.sparkContext.broadcast(trees)

    def deal(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for k in range(0, batch.num_rows, 4_096):
            wide, prints = unpacked(batch.column("print").slice(k, 4_096))
            wide = wide.view(np.int64)
            for t, tree in enumerate(shared.value):
                row, shard, home = route(tree, prints[:, t], REACH)
                near = prints[row, t].astype(np.int32) | home.astype(np.int32) << BITS
                yield pa.RecordBatch.from_arrays([pa.array(shard * TABLES + t, pa.int32()), pa.array(near), pa.array(wide[row, 0]), pa.array(wide[row, 1])], names=["shard", "near", "w0", "w1"])

    dealt = map_batches(nodes, deal, "shard int, near int, w0 long, w1 long")
    # a number for each shard with more rows than one task takes: fewer than there are shards
    crowded = {}
    if count > PIECE:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
        crowded = {x["shard"]: -(-x["n"] // PIECE) for x in sizes.collect()}
    if crowded:
        cut = dealt.join(F.broadcast(spark.createDataFrame(list(crowded.items()), "shard int, pieces long")), "shard", "left")
        cut = cut.withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
        dealt = cut.withColumn("piece", F.explode(meetings(F.xxhash64("w0", "w1"), F.col("pieces")))).drop("pieces")
    else:
        dealt = dealt.withColumn("piece", F.lit(0).cast("long"))

    def edges(table):
        import numpy as np
        import pyarrow as pa

        near = table.column("near").to_numpy()
        wide = np.stack([table.column(x).to_numpy() for x in ("w0", "w1")], axis=1).view(np.uint64)
        # the smallest of a group names it, so that trees which find the same group give the same edges
        order = np.lexsort((near, wide[:, 1], wide[:, 0]))
        near, wide = near[order], wide[order]
        root = candidates_within((near & ((1 << BITS) - 1)).astype(np.uint32), wide, near >> BITS > 0).roots(np.arange(len(near)))
        other = np.flatnonzero((root != np.arange(len(near))) & (wide[root] != wide).any(axis=1))
        return pa.table({k: pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDE // 8), len(other), [None, pa.py_buffer(wide[x].tobytes())]).cast(pa.binary()) for k, x in (("a", root[other]), ("b", other))})

    dealt = dealt.repartition(partitions_for(spark, count * TABLES * 64, 8 << 20), "shard", "piece")
    return dealt.groupBy("shard", "piece").applyInArrow(edges, "a binary, b binary")


def meetings(number, tiles):
    """The tasks, one for each two of ``tiles``, where a row with this hash takes part."""
    own = F.pmod(number, tiles)
    return F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda x: F.least(own, x) * tiles + F.greatest(own, x))


def parities(sets: list):
    """1,024 bits a set, each the parity of how many of its hashes fall there: two sets differ in at least as many hashes as bits."""
    import numpy as np

    out = np.zeros((len(sets), 16), np.uint64)
    for k, hashes in enumerate(sets):
        odd = np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def link(sets: list, similarity: float):
    """The group of each set, as the number of one in it; every pair in reach is compared or in one group already."""
    import numpy as np

    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bits, starts = parities(sets), np.cumsum(sizes) - sizes
    group, left, has = np.arange(n), np.ones(n, bool), np.zeros(len(words))
    while True:
        # who is left of the smallest group is compared to all others, until one group is left
        count = np.bincount(group[left], minlength=n)
        if np.count_nonzero(count) < 2:
            return group
        smallest = np.where(count > 0, count, n + 1).argmin()
        one = np.flatnonzero(left & (group == smallest))[0]
        left[one] = False
        # bits that differ are hashes that differ, and in reach these are at most that share of both sets together
        some = np.flatnonzero(left)
        most = (sizes[some] + sizes[one]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        some = some[np.bitwise_count(bits[some] ^ bits[one]).sum(axis=1, dtype=np.int64) <= most]
        if not len(some):
            continue
        own, length = ids[starts[one] : starts[one] + sizes[one]], sizes[some]
        ends = np.cumsum(length)
        theirs = ids[np.repeat(starts[some] - (ends - length), length) + np.arange(ends[-1])]
        has[own] = 1
        both = np.bincount(np.repeat(np.arange(len(some)), length), has[theirs], len(some))
        has[own] = 0
        near = np.append(some[both >= similarity * (length + sizes[one] - both) - 1e-9], one)
        group[np.isin(group, group[near])] = group[near].min()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, key, n_hashes, prints): what names a row's set, its size, and its long SimHashes."""

    def run(batch) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for part in pieces_of(batch, "text", 4 << 20):
            sets = [shingles(x, size) for x in raw_bytes(part.column("text"))]
            prints = [long_prints(s) for s in sets]
            keys = pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), keys, pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.list_(pa.binary()))], names=["doc_id", "text_key", "key", "n_hashes", "prints"])

    named = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return map_batches(spread(named).withColumn("text_key", F.xxhash64("text")), run, "doc_id long, text_key long, key binary, n_hashes long, prints array<binary>")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(key, hashes): the whole sets of ``texts`` (text), made anew, as texts are half as large."""

    def run(batch) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for part in pieces_of(batch, "text", 4 << 20):
            hashes = [shingles(x, size).tobytes() for x in raw_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(x) for x in hashes], pa.binary()), pa.array(hashes, pa.binary())], names=["key", "hashes"])

    return map_batches(texts.select("text"), run, "key binary, hashes binary")


def linked(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, grp and component_id for every row of ``docs`` that has a doc_id."""
    rows = materialise(sketches(docs, size), "sketches")
    nodes = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_hashes").alias("n_hashes"), F.first("prints").alias("prints")), "nodes")
    wide = lambda x: F.substring(x, 1, WIDE // 8)
    edges = candidate_edges(nodes.select(F.explode("prints").alias("print")))
    both = nodes.where("size(prints) > 1").select(wide(F.col("prints")[0]).alias("a"), wide(F.col("prints")[1]).alias("b"))
    labels = components(materialise(edges.unionByName(both).distinct(), "candidates"))
    named = nodes.select("key", "doc_id", "n_hashes", wide(F.col("prints")[0]).alias("node")).join(labels, "node", "left")
    held = materialise(named.select("key", "doc_id", "n_hashes", F.coalesce("component", "node").alias("band")), "held")
    shared = held.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_hashes").alias("size")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") / TILE_HASHES)).cast("long")
    met = look_up(held, materialise(shared.select("band", "n", tiles.alias("tiles")), "shared"), "band", count="n")
    members = met.select("band", F.explode(meetings(F.xxhash64("key", F.lit(9)), F.col("tiles"))).alias("tile"), "key", "doc_id")
    members = materialise(members, "members")
    # one row for each set that is in question: of those that hold it, the smallest doc_id's
    wanted = rows.join(members.select("key", "doc_id").distinct(), ["key", "doc_id"], "left_semi")
    wanted = materialise(wanted.groupBy("key", "doc_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("n")), "wanted")
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_key", F.xxhash64("text"))
    texts = keyed.join(wanted, ["doc_id", "text_key"], "left_semi")
    if not wanted.where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "text_key"])
    sets = sets_of(texts, size)

    def verified(table):
        import numpy as np
        import pyarrow as pa

        key = table.column("key")
        group = link([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], similarity)
        other = np.flatnonzero(group != np.arange(len(group)))
        return pa.table({"a": key.take(pa.array(group[other])), "b": key.take(pa.array(other))})

    ship(docs.sparkSession)
    met = members.select("band", "tile", "key").join(sets, "key")
    close = materialise(met.groupBy("band", "tile").applyInArrow(verified, "a binary, b binary"), "close")
    return name_groups(rows.select("doc_id", "text_key", "key"), close, "key")
