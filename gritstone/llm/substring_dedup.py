"""Exact substring deduplication by super-k-mers of words.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among its word
``grain``-grams. Consecutive windows with the same minimiser form a super-k-mer: it travels to the
minimiser's bucket as one packed string, so a word is sent about three times instead of ``window``
times. Equal windows have equal minimisers and meet in one bucket. There the windows of all packed
strings are sorted by a rolling hash; windows that share a hash are compared as bytes, so the count
is exact. All but the first (smallest doc_id, then start) are repeats, and the words that repeats
cover are removed.

Hot minimisers: words that many texts share may take far more than a bucket's share to one bucket.
One text in ``SAMPLE_OF``, chosen by a hash, tells which buckets are so large; their windows are dealt
by a second minimiser of an independent hash instead, and by a third where that is crowded too. A
window's words alone decide its bucket, so equal windows still meet.

Hot passages: equal packed strings are combined before the shuffle, where all but the first in a
batch are repeats already and travel as a few numbers in a bucket of their document's own. A bucket
reads its strings one batch at a time and holds each distinct one once.

Defined cases: a null text has no words (n_words 0, the hash of the empty text); texts shorter than
a window are kept whole; rows equal in doc_id and text are one document and get the same answer; rows
that repeat a doc_id with another text are documents of their own, in the order of a hash of the text;
a row whose doc_id is null is kept whole and removes nothing; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_rows, map_batches, partitions_for, pieces_of, raw_bytes, ship, spread, text_bytes

#: Bytes of text for each shuffle partition, and buckets in as much text.
BYTES_EACH, BUCKETS_EACH = 16 << 20, 4
#: Windows of one super-k-mer at most, so that text that repeats itself is cut into equal strings.
LONGEST = 64
#: One text in so many tells which buckets are crowded: those with more bytes of strings than this.
SAMPLE_OF, CROWDED = 16, 64 << 20
#: For each minimiser in turn, an odd multiplier of its hash.
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Repeats that a bucket holds back before it returns them.
HELD = 200_000


def _minima(values, width: int):
    """The smallest of each ``width`` consecutive values."""
    import numpy as np

    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def minimisers(words: list[bytes], window: int, grain: int, turn: int = 0):
    """The smallest mixed hash among the word grams of every window."""
    import zlib

    import numpy as np

    hashed = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = hashed[: len(words) - grain + 1].copy()
    for k in range(1, grain):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - grain + 1 + k]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(MIXERS[turn])
    grams ^= grams >> np.uint64(29)
    return _minima(grams, window - grain + 1)


def _stretches(values, index):
    """(first, end) of the stretches of consecutive ``index`` with one value, of ``LONGEST`` at most."""
    import numpy as np

    new = np.concatenate([[True], (values[1:] != values[:-1]) | (index[1:] != index[:-1] + 1)])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(index)))
    starts = index[at]
    ends = starts + sizes
    if len(sizes) and sizes.max() > LONGEST:
        counts = -(-sizes // LONGEST)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        last = np.repeat(ends, counts)
        starts = np.repeat(starts, counts) + nth * LONGEST
        ends = np.minimum(starts + LONGEST, last)
    return starts, ends


def super_kmers(words: list[bytes], window: int, grain: int, buckets: int, crowded=()):
    """(buckets, first window, last window + 1) of the super-k-mers of one document's words.

    ``crowded`` holds for each turn but the last the sorted buckets whose windows the next turn deals out.
    """
    import numpy as np

    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out, index = [], np.arange(len(words) - window + 1)
    for turn in range(len(crowded) + 1):
        least = minimisers(words, window, grain, turn)
        starts, ends = _stretches(least[index], index)
        bucket = (least[starts] % np.uint64(buckets)).astype(np.int64) + turn * buckets
        again = np.isin(bucket, crowded[turn]) if turn < len(crowded) and len(crowded[turn]) else np.zeros(len(bucket), bool)
        out.append((bucket[~again], starts[~again], ends[~again]))
        if not again.any():
            break
        sizes = (ends - starts)[again]
        index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[again], sizes)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(strings: list[bytes], firsts: list[tuple[int, int, int]], spans: list[tuple[int, int, int, int]]) -> bytes:
    import numpy as np
    import zstandard

    head = np.array([len(strings), len(spans)], np.int64).tobytes()
    parts = [np.array(firsts, np.int64).T.tobytes(), np.array(spans, np.int64).tobytes(), b"\n".join(strings)]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(payload: bytes):
    """(strings, places of their first windows, known repeats): a place is doc_id, text_key and start."""
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(payload)
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    firsts = np.frombuffer(data, np.int64, 3 * n, 16).reshape(3, -1)
    spans = np.frombuffer(data, np.int64, 4 * m, 16 + 24 * n).reshape(-1, 4)
    text = data[16 + 24 * n + 32 * m :]
    return text.split(b"\n") if n else [], firsts, spans


def _cut(batch, window: int, grain: int, buckets: int, crowded) -> Iterator:
    """For every document of a batch: doc_id, text_key, the joined words, where each begins, and its super-k-mers."""
    columns = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), raw_bytes(batch.column("text"))
    for doc, key, text in zip(*columns, strict=True):
        if doc is None or not text:
            continue
        words = text.split()
        dealt, starts, ends = super_kmers(words, window, grain, buckets, crowded)
        if len(dealt):
            at, total = [0], 0
            for word in words:
                total += len(word) + 1
                at.append(total)
            yield doc, key, b" ".join(words), at, zip(dealt.tolist(), starts.tolist(), ends.tolist(), strict=True)


def crowded_buckets(docs: DataFrame, window: int, grain: int, buckets: int) -> list:
    """The buckets of each turn but the last that get more than ``CROWDED`` bytes, by a hash sample of the texts."""
    import numpy as np

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text_key", F.lit(13)), F.lit(SAMPLE_OF)) == 0)
    found: list = []
    for turn in range(len(MIXERS) - 1):

        def run(batch, known=tuple(found), turn=turn) -> Iterator:
            import pyarrow as pa

            sums: dict[int, int] = {}
            for _, _, _, at, dealt in _cut(batch, window, grain, buckets, [*known, []]):
                for bucket, a, b in dealt:
                    if bucket // buckets == turn:
                        sums[bucket] = sums.get(bucket, 0) + at[b + window - 1] - at[a]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array(sums.values(), pa.int64())], names=["bucket", "size"])

        sizes = map_batches(spread(some), run, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
        # at most the bytes of all strings over CROWDED
        large = [x["bucket"] for x in sizes.where(F.col("size") * SAMPLE_OF > CROWDED).select("bucket").collect()]
        if not large:
            break
        found.append(np.array(sorted(large), np.int64))
    return found


def _blocks(docs: DataFrame, window: int, grain: int, buckets: int) -> DataFrame:
    """(bucket, payload): packed strings of a batch with their first occurrence, and known repeats."""
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_buckets(docs, window, grain, buckets))

    def run(batch) -> Iterator:
        import pyarrow as pa

        for part in pieces_of(batch, "text", 8 << 20):
            first: dict[bytes, tuple[int, int, int]] = {}
            home: dict[bytes, int] = {}
            spans: dict[int, list] = {}
            for doc, key, joined, at, dealt in _cut(part, window, grain, buckets, crowded.value):
                for bucket, a, b in dealt:
                    string = joined[at[a] : at[b + window - 1] - 1]
                    here = (doc, key, a)
                    known = first.setdefault(string, here)
                    if known is here:
                        home[string] = bucket
                    elif known != here:
                        later, first[string] = (known, here) if here < known else (here, known)
                        spans.setdefault((later[0] * 31 + later[1]) % buckets, []).append((*later, later[2] + b - a))
            dealt_out: dict[int, list] = {}
            for string, bucket in home.items():
                dealt_out.setdefault(bucket, []).append(string)
            rows, payloads = [], []
            for bucket in dealt_out.keys() | spans.keys():
                strings = sorted(dealt_out.get(bucket, ()))
                rows.append(bucket)
                payloads.append(_pack(strings, [first[x] for x in strings], spans.get(bucket, [])))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])

    return map_batches(spread(docs), run, "bucket long, payload binary")


#: An odd multiplier and its inverse modulo 2**64, for rolling hashes of byte strings.
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)


def _window_hashes(strings: list[bytes], window: int):
    """(row, first byte, end byte, hash) of every window of the strings, in the joined bytes."""
    import numpy as np

    data = b"\n".join(strings) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    word_start = np.concatenate([[0], gaps[:-1] + 1])
    row = np.concatenate([[0], np.cumsum(raw[gaps[:-1]] == 10)])
    n = len(gaps) - window + 1
    same = row[:n] == row[window - 1 :]
    index = np.flatnonzero(same)
    begin, end = word_start[index], gaps[index + window - 1]
    powers = np.empty(len(raw), np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(FACTOR)
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    back = powers
    back[0] = 1
    back[1:] = np.uint64(INVERSE)
    np.multiply.accumulate(back, out=back)
    hashed = (sums[end] - sums[begin]) * back[begin]
    # where a string's words begin, to number its windows
    string_first = np.searchsorted(row, np.arange(len(strings)))
    return data, row[index], index - string_first[row[index]], begin, end, hashed


def _repeats(strings: list[bytes], places, window: int):
    """Runs (doc_id, text_key, first window, last window + 1) of repeats among distinct packed strings."""
    import numpy as np

    data, row, nth, begin, end, hashed = _window_hashes(strings, window)
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    equal = ordered[1:] == ordered[:-1]
    many = np.zeros(len(order), bool)
    many[1:] |= equal
    many[:-1] |= equal
    some = order[many]
    doc, key, start = places[0][row[some]], places[1][row[some]], places[2][row[some]] + nth[some]
    is_repeat = np.zeros(len(some), bool)
    # in order of place, so the first to hold a window is its first occurrence
    by_place = np.lexsort((start, key, doc)).tolist()
    first_at: dict[bytes, tuple[int, int, int]] = {}
    b, e, d, t, s = (x.tolist() for x in (begin[some], end[some], doc, key, start))
    for k in by_place:
        place = (d[k], t[k], s[k])
        if first_at.setdefault(data[b[k] : e[k]], place) != place:
            is_repeat[k] = True
    start = start[is_repeat]
    return _runs(np.stack([doc[is_repeat], key[is_repeat], start, start + 1], axis=1))


def _runs(spans):
    """Spans merged where one begins at another's end, within a document; others stay apart."""
    import numpy as np

    if not len(spans):
        return np.empty((0, 4), np.int64)
    doc, key, start, end = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))].T
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return np.stack([doc[at], key[at], start[at], np.maximum.reduceat(end, at)], axis=1)


class Bucket:
    """The distinct strings of one bucket with the place of their first occurrence."""

    def __init__(self, window: int):
        self.window, self.first, self.later, self.held = window, {}, [], 0

    def add(self, payload: bytes) -> None:
        import numpy as np

        strings, places, spans = _unpack(payload)
        found = []
        for string, here in zip(strings, zip(*places.tolist(), strict=True), strict=True):
            known = self.first.setdefault(string, here)
            if known != here:
                if here < known:
                    self.first[string], here = here, known
                found.append((*here, here[2] + string.count(b" ") + 2 - self.window))
        self.later += [x for x in (spans, np.array(found, np.int64)) if len(x)]
        self.held += len(spans) + len(found)

    def known(self):
        """The repeats found so far, which are let go."""
        import numpy as np

        out = _runs(np.concatenate(self.later)) if self.later else np.empty((0, 4), np.int64)
        self.later, self.held = [], 0
        return out

    def rest(self):
        """The repeats among windows of different strings."""
        import numpy as np

        return _repeats(list(self.first), np.array(list(self.first.values()), np.int64).T, self.window) if self.first else np.empty((0, 4), np.int64)


def repeated_windows(docs: DataFrame, window: int = 20, grain: int = 3) -> DataFrame:
    """(doc_id, text_key, first, last): runs of windows of ``docs`` (doc_id, text, text_key) whose words also start earlier."""
    size = text_bytes(docs)
    parts = partitions_for(docs.sparkSession, size, BYTES_EACH)
    blocks = _blocks(docs, window, grain, parts * max(BUCKETS_EACH, -(-size * BUCKETS_EACH // (parts * BYTES_EACH))))

    def emit(spans):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(spans[:, k]) for k in range(4)], names=["doc_id", "text_key", "first", "last"])

    def run(batches: Iterable) -> Iterator:
        bucket, here = None, None
        for batch in batches:
            for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if b != here:
                    if bucket:
                        yield emit(bucket.known())
                        yield emit(bucket.rest())
                    bucket, here = Bucket(window), b
                bucket.add(payload)
                if bucket.held > HELD:
                    yield emit(bucket.known())
        if bucket:
            yield emit(bucket.known())
            yield emit(bucket.rest())

    ship(docs.sparkSession)
    dealt = blocks.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, text_key long, first long, last long")


def remove_repeats(docs: DataFrame, window: int = 20, grain: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_key", F.xxhash64("text"))
    key = ["doc_id", "text_key"]
    parts = partitions_for(docs.sparkSession, text_bytes(docs), BYTES_EACH)
    runs = repeated_windows(docs, window, grain).repartition(parts, *key).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = docs
    if (hot := hot_rows(docs, *key)) is not None:
        # rows that one of a bounded number of documents repeats over and over stay where they are
        rows = docs.join(F.broadcast(hot), key, "left_anti")
    joined = rows.repartition(parts, *key).join(runs.hint("merge"), key, "left")
    if hot is not None:
        joined = joined.unionByName(docs.join(F.broadcast(hot), key).join(F.broadcast(runs.join(F.broadcast(hot), key, "left_semi")), key, "left"))

    def cut(batch) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        ids = batch.column("doc_id")
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(raw_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            words = text.split() if text else []
            n_words.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [x["first"] for x in spans], 1)
                np.add.at(change, [min(x["last"] + window - 1, len(words)) for x in spans], -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            else:
                kept = words
            n_removed.append(len(words) - len(kept))
            kept_texts.append(b" ".join(kept))
            digests.append(hashlib.sha256(kept_texts[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_batches(joined.select("doc_id", "text", "runs"), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
