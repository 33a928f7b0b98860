"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become token ids and an end id; one longer than a sequence is cut so that its first piece
takes the remainder and all others are full. Full pieces are sequences of their own. The rest is
dealt out over groups of bounded size, each packed by best-fit decreasing. Dual feasible functions
bound from below how many sequences a group's pieces need: where the bound is met, no packing of them
is better and the group is certified. The open sequences of groups with a gap, and the emptiest one
of each certified group, give their pieces to a pool that is dealt out anew over at most half as many
groups and packed again, until the pool is empty or is one group. ``certified`` and ``gap`` say for
every piece whether the group that placed it met its bound, and by how many sequences it missed it.

A partition packs its groups one after another, so the number of partitions bounds no group, and
pieces are dealt by their place in a batch too, so equal rows are spread like any others.

Defined cases: a null text is an empty one, which is the end id alone; repeated rows and repeated
doc_ids are packed once each; a null doc_id is kept; columns other than doc_id and text are ignored;
an empty table gives an empty result. A text of any length is cut, never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_PARTITIONS, encoder, map_batches, materialise, pieces_of, ship, spread

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
#: Pieces in a group, on average.
EACH = 30_000


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; ``deal`` spreads the pieces evenly."""

    def cut(batch) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code = encoder(vocabulary, end_id)
        for part in pieces_of(batch, "text", 16 << 20):
            ids, ends = code.encode(part.column("text"))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sizes = ends - starts
            count = -(-sizes // capacity)
            first = sizes - (count - 1) * capacity
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            data = memoryview(ids.tobytes())
            at = (starts[row] + begin) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            doc = part.column("doc_id").take(pa.array(row))
            deal = (np.array(crc, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + pc.fill_null(doc, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0x94D049BB133111EB) + np.arange(len(row), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(17)
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return map_batches(spread(docs.select(F.col("doc_id").cast("long"), "text")), cut, PIECES)


def bound(lengths, capacity: int) -> int:
    """The fewest sequences that could hold ``lengths``, by two families of dual feasible functions.

    For a threshold k up to half the capacity, the first counts a length above capacity - k as a
    whole sequence, one below k as nothing, any other as itself. The second scales by the rounding
    function with parameter k: floor((k + 1) * x / capacity) / k where x * (k + 1) is not a multiple.
    """
    import numpy as np

    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    total, best = np.cumsum(count * sizes), -(-int((count * sizes).sum()) // capacity)
    number = np.cumsum(count)
    k = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        units = np.where(whole, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * units).sum()) // (k * capacity)))
    return best


def best_fit(lengths, capacity: int):
    """(bin, offset) of each length by best-fit decreasing; equal lengths go in the order given."""
    import numpy as np

    order = np.argsort(-np.asarray(lengths), kind="stable").tolist()
    sizes = np.asarray(lengths).tolist()
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for item in order:
        size = sizes[item]
        above = some >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            home = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, home, bins = capacity, bins, bins + 1
        where[item], offset[item] = home, capacity - room
        if left := room - size:
            free[left].append(home)
            some |= 1 << left
    return where, offset


def _pack(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Each of ``groups`` packed; ``closed`` is true for what stays as it is packed."""

    def settle(held: list, group: int):
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        where, offset = best_fit(lengths, capacity)
        used = np.bincount(where, weights=lengths).astype(np.int64)
        gap = len(used) - bound(lengths, capacity)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
        out = out.append_column("sequence_id", pa.array(_number(turn, group, where)))
        out = out.append_column("offset", pa.array(offset))
        out = out.append_column("gap", pa.array(np.full(len(where), gap, np.int64)))
        # a certified group keeps its sequences but the emptiest, which others may still fill
        settled = (used == capacity) | ((gap == 0) & (np.arange(len(used)) != used.argmin()))
        out = out.append_column("closed", pa.array(settled[where]))
        return out.combine_chunks().to_batches()

    def pack(batches) -> Iterator:
        import numpy as np

        held, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column("grp").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and which[a] != group:
                    yield from settle(held, group)
                    held = []
                group = int(which[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(held, group)

    ship(pieces.sparkSession)
    parts = min(MOST_PARTITIONS, groups)
    dealt = pieces.withColumn("grp", F.pmod(F.col("deal") + turn * 7919, F.lit(groups)))
    schema = f"{PIECES}, sequence_id long, offset long, gap long, closed boolean"
    return dealt.repartitionById(parts, (F.col("grp") % parts).cast("int")).sortWithinPartitions("grp").mapInArrow(pack, schema)


def _number(turn: int, group: int, where):
    """A sequence number that no other turn or group gives: 5, 34 and 24 bits."""
    return (turn << 58) + (group << 24) + where


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, each: int = EACH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified and gap for every piece of ``docs``."""
    pieces = materialise(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"]
    full = F.lit(31 << 58).bitwiseOR(F.monotonically_increasing_id())
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": full, "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    pool, done, turn = pieces.where(F.col("length") < capacity), [whole.select(names)], 0
    groups = max(1, -(-pool.count() // each))
    while True:
        packed = materialise(_pack(pool, groups, turn, capacity), f"packed{turn}")
        done.append(packed.where("closed").select(names))
        pool = packed.where("not closed")
        left = pool.count()
        if groups == 1 or not left:
            done.append(pool.select(names))
            break
        pool, turn = pool.select([x.split()[0] for x in PIECES.split(", ")]), turn + 1
        groups = min(-(-groups // 2), max(1, -(-left // each)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("certified", F.col("gap") == 0)
