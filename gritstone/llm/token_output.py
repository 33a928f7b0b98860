"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

Every text is encoded once; the ids are counted over the whole corpus by vocabulary entry, and one
code is built from the counts by package-merge: of at most ``LIMIT`` bits, or as many more as so many
ids need. Documents keep the order of their doc_id: a prefix sum over their token counts gives each
its place and cuts the order into files of about ``file_tokens`` ids, whose first rows (a few numbers
per file) deal the documents out. A file is a run of blocks of whole documents. A block holds its
documents' numbers and token counts, its codes as one bit string and the bit offset of every
``STEP``-th token; with these checkpoints all stretches of a block are decoded side by side by table
look-up. The blocks lie in the rows of Parquet files below ``blocks``, so that Spark's commit protocol
replaces what a lost task left behind, and any store that Spark reaches will do. The code lengths lie
beside them below ``code``: the path alone is enough to read all.

Rows are told apart by doc_id, a hash of their ids and a number of their own, so rows of one doc_id
or of none are spread over files like any others.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id follow each
other, ordered by what they hold; rows whose doc_id is null come first; an empty table gives no
blocks; other columns are ignored; a document longer than a block or a file is a block of its own;
a vocabulary of over 2 ** 24 used ids raises an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, map_batches, materialise, partitions_for, pieces_of, ship, spread

#: Longest code in bits, tokens between checkpoints, tokens of a block and of a file.
LIMIT, STEP, BLOCK_TOKENS, FILE_TOKENS = 16, 64, 1 << 17, 1 << 22
#: Files at most, as their first rows go to every task. Beyond 4e11 tokens files grow, but no block and no task's memory.
MOST_FILES = 100_000
BLOCKS, CODE = "file long, block long, payload binary", "size int, lengths binary"


def code_lengths(counts, limit: int = LIMIT):
    """Optimal code lengths of at most ``limit`` bits, or one more than the used ids need, for ids with a count; 0 for the others."""
    import numpy as np

    used = np.flatnonzero(counts)
    limit = max(limit, int(len(used)).bit_length() + 1) if len(used) > 1 << limit else limit
    if limit > 25:
        raise ValueError("too many ids for codes of 25 bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = np.asarray(counts, np.float64)[used]
    order = np.argsort(weights, kind="stable")
    leaves = weights[order]
    # package-merge: the pairs of one level join the leaves of the next; a leaf's code is as long as
    # the number of levels at which it is among the items taken
    levels, row = [], leaves
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place < len(leaves))
        row = both[place]
    taken = 2 * (len(leaves) - 1)
    depth = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        some = int(is_leaf[:taken].sum())
        depth[:some] += 1
        taken = 2 * (taken - some)
    depth[:taken] += 1
    lengths[used[order]] = depth
    return lengths


def canonical(lengths):
    """(codes, table of symbols, table of lengths): codes count up by length, then by id."""
    import numpy as np

    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    size = lengths[order].astype(np.int64)
    limit = max(LIMIT, int(size.max(initial=1)))
    steps = np.int64(1) << (limit - size)
    starts = np.cumsum(steps) - steps
    codes[order] = (starts >> (limit - size)).astype(np.uint32)
    symbols, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    total = int(steps.sum())
    symbols[:total], bits[:total] = np.repeat(order, steps), np.repeat(size, steps)
    return codes, symbols, bits


def write_bits(ids, codes, lengths):
    """(bytes, bit offset of every STEP-th token): the codes one after another, high bits first."""
    import numpy as np

    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    words = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 2, np.uint64)
    slot, inside = starts >> 5, starts & 31
    spread_code = codes[ids].astype(np.uint64) << (64 - inside - size).astype(np.uint64)
    # a code reaches into the next 32-bit slot at most; codes of one slot do not overlap, so sums are unions
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, np.int64)
    if len(slot):
        high = np.add.reduceat(spread_code >> np.uint64(32), first)
        low = np.add.reduceat(spread_code & np.uint64(0xFFFFFFFF), first)
        words[slot[first]] += high
        words[slot[first] + 1] += low
    return words.astype(">u4").tobytes(), starts[::STEP]


def read_bits(data: bytes, offsets, n: int, symbols, bits):
    """The ``n`` ids of a bit string, all stretches between checkpoints in step."""
    import numpy as np

    limit = len(symbols).bit_length() - 1
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.array(offsets, np.int64)
    out = np.zeros((len(at), STEP), np.uint32)
    for k in range(STEP):
        peek = (window[np.minimum(at >> 3, len(window) - 1)] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, k] = symbols[peek]
        at = at + bits[peek]
    return out.ravel()[:n]


def pack_block(docs: list, sizes: list[int], start: int, ids, codes, lengths) -> bytes:
    """A block's bytes: counts, place, documents (with a flag for null), token counts, checkpoints, bits."""
    import numpy as np

    data, offsets = write_bits(ids, codes, lengths)
    head = np.array([len(docs), len(ids), start, len(offsets)], "<i8")
    names = np.array([0 if x is None else x for x in docs], "<i8")
    missing = np.array([x is None for x in docs], np.uint8)
    return b"".join([head.tobytes(), names.tobytes(), np.array(sizes, "<i8").tobytes(), offsets.astype("<u4").tobytes(), missing.tobytes(), data])


def unpack_block(payload: bytes, symbols, bits):
    """(doc_ids, token counts, place of the first token, ids) of a block."""
    import numpy as np

    docs, tokens, start, checks = np.frombuffer(payload, "<i8", 4).tolist()
    at = 32
    names = np.frombuffer(payload, "<i8", docs, at).tolist()
    sizes = np.frombuffer(payload, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    offsets = np.frombuffer(payload, "<u4", checks, at)
    missing = np.frombuffer(payload, np.uint8, docs, at + 4 * checks).tolist()
    at += 4 * checks + docs
    ids = read_bits(payload[at:], offsets, tokens, symbols, bits)
    return [None if m else x for x, m in zip(names, missing, strict=True)], sizes, start, ids


def token_rows(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every text as 16- or 32-bit numbers, whichever hold them."""

    def run(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        code = encoder(vocabulary, end_id)
        narrow = np.uint16 if code.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        for part in pieces_of(batch, "text", 16 << 20):
            ids, ends = code.encode(part.column("text"))
            width = np.dtype(narrow).itemsize
            offsets = np.concatenate([[0], ends]) * width
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(narrow).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(np.full(len(ends), width), pa.int32()), binary.cast(pa.binary())], names=["doc_id", "n_tokens", "width", "ids"])

    return map_batches(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, "doc_id long, n_tokens long, width int, ids binary")


def count_ids(rows: DataFrame, size: int):
    """How often each id occurs: at most ``size`` numbers, summed up per task first."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(size, np.int64)
        for batch in batches:
            for width, kind in ((2, np.uint16), (4, np.uint32)):
                ids = b"".join(x for w, x in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True) if w == width)
                counts += np.bincount(np.frombuffer(ids, kind), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["id", "n"])

    import numpy as np

    ship(rows.sparkSession)
    total = np.zeros(size, np.int64)
    for x in rows.select("width", "ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[x["id"]] = x["n"]
    return total


#: What puts rows in order; ``number`` tells equal ones apart.
ORDER = ["doc_id", "ids_key", "number"]


def file_starts(rows: DataFrame, file_tokens: int) -> list[tuple[tuple, int]]:
    """(first row's ``ORDER``, place of its first token) of every file, in order: four numbers a file."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    # 40 bytes a row at most
    parts = partitions_for(spark, rows.count() * 40, 64 << 20)
    dealt = rows.repartitionByRange(parts, *[F.col(x).asc_nulls_first() for x in ORDER]).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "sizes")
    totals = {x["part"]: x["n"] for x in dealt.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, places = 0, []
    for part in sorted(totals):
        places.append((part, before))
        before += totals[part]
    if not places:
        return []
    file_tokens = max(file_tokens, -(-before // MOST_FILES))
    base = spark.createDataFrame(places, "part int, before long")
    in_order = Window.partitionBy("part").orderBy(*[F.col(x).asc_nulls_first() for x in ORDER])
    running = F.sum("n_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.join(F.broadcast(base), "part").withColumn("start", F.col("before") + F.coalesce(running, F.lit(0)))
    placed = placed.withColumn("file", F.floor(F.col("start") / file_tokens))
    # the first row of a file is where the number of the file steps up, or where a part begins
    last = F.lag("file").over(in_order)
    first = placed.withColumn("last", last).where(F.col("last").isNull() | (F.col("last") != F.col("file")))
    out, known = [], set()
    for x in sorted(first.select("start", "file", *ORDER).collect(), key=lambda x: x["start"]):
        if x["file"] not in known:
            known.add(x["file"])
            out.append((tuple(x[c] for c in ORDER), x["start"]))
    return out


def in_order(doc_id: int | None, ids_key: int, number: int) -> tuple:
    """A key that sorts rows as :data:`ORDER` does, without a doc_id first."""
    return doc_id is not None, doc_id or 0, ids_key, number


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, file_tokens: int = FILE_TOKENS) -> None:
    """Write the token files of ``docs`` below ``path``, with the code that decodes them."""
    import zlib

    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = token_rows(docs, vocabulary, end_id).withColumn("ids_key", F.xxhash64("ids")).withColumn("number", F.monotonically_increasing_id())
    rows = materialise(rows, "tokens")
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    lengths = code_lengths(count_ids(rows, size))
    starts = file_starts(rows.select(*ORDER, "n_tokens"), file_tokens)
    spark.createDataFrame([(size, bytearray(zlib.compress(lengths.tobytes())))], CODE).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lengths, [in_order(*x[0]) for x in starts], [x[1] for x in starts]))

    def encode(batch) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        firsts = shared.value[1]
        file = [bisect_right(firsts, in_order(*x)) - 1 for x in zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), *[batch.column(c) for c in (*ORDER, "width", "ids")]], names=["file", *ORDER, "width", "ids"])

    def pack(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lengths, _, starts = shared.value
        codes, _, _ = canonical(lengths)
        held, sizes, docs, file, block, place, tokens = [], [], [], None, 0, 0, 0

        def close():
            ids = np.concatenate(held)
            payload = pack_block(docs, sizes, place, ids, codes, lengths)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])

        for batch in batches:
            for f, doc, width, ids in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and (f != file or tokens >= BLOCK_TOKENS):
                    yield close()
                    place, block = place + tokens, block + 1
                    held, sizes, docs, tokens = [], [], [], 0
                if f != file:
                    file, block, place = f, 0, starts[f]
                held.append(np.frombuffer(ids, np.uint16 if width == 2 else np.uint32).astype(np.int64))
                sizes.append(len(held[-1]))
                tokens += sizes[-1]
                docs.append(doc)
        if held:
            yield close()

    dealt = map_batches(rows, encode, "file long, doc_id long, ids_key long, number long, width int, ids binary")
    parts = max(1, min(len(starts), 20_000))
    dealt = dealt.repartitionById(parts, (F.col("file") % parts).cast("int")).sortWithinPartitions("file", *[F.col(x).asc_nulls_first() for x in ORDER])
    dealt.select("file", "doc_id", "width", "ids").mapInArrow(pack, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files below ``path``."""
    import zlib

    import numpy as np

    # one row, of a byte for each id of the vocabulary before compression
    code = spark.read.schema(CODE).parquet(f"{path}/code").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(zlib.decompress(bytes(code["lengths"])), np.uint8))

    def run(batches: Iterable) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        _, symbols, bits = canonical(shared.value)
        for batch in batches:
            for payload in batch.column("payload"):
                docs, sizes, start, ids = unpack_block(payload.as_py(), symbols, bits)
                ends = np.cumsum(sizes)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(spark)
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
