"""What the operators of this subpackage share: intermediate tables, tokenizers, components.

Every operator takes and returns DataFrames. Where a stage is needed twice it is written once as
Parquet below the session's ``spark.checkpoint.dir`` and read again: a lost executor then costs
the tasks it ran, never the stages before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder, ship
from ..sources.tables import spread

__all__ = ["components", "drop_tables", "encoder", "hash_sample", "hot_rows", "look_up", "map_batches", "materialise", "partitions_for", "pieces_of", "raw_bytes", "shared_folder", "ship", "spread", "text_bytes", "written"]

_written: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables that :func:`materialise` has written so far and that are still there."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that :func:`materialise` has written, once no result reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in (own := _written.get(spark.sparkContext.applicationId, [])):
            own.remove(path)


#: No shuffle has more partitions than this, whatever the input: beyond it the driver's books of them are the limit.
MOST_PARTITIONS = 50_000


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The bytes in ``column``, counted: the optimiser knows no size of tables in memory and guesses that of joins."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions_for(spark: SparkSession, size: int, bytes_each: int) -> int:
    """Shuffle partitions for ``size`` bytes: at least the session's, more where there is more."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, own, min(MOST_PARTITIONS, -(-size // bytes_each)))


def hash_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of ``columns`` below a threshold.

    The same rows whatever the partitions, and each task sends only what is chosen; the first rows in
    an order would send ``most`` from every task. The threshold leaves room for chance.
    """
    n = df.count()
    if n <= most:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(*columns, F.lit(5)), F.lit(span)) < int(span * 0.95 * most / n))


#: Bytes of an Arrow batch where the session keeps Spark's own 64 MB: a worker holds several copies of one.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"


def map_batches(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with ``func(batch) -> iterable of batches`` and this package shipped."""
    ship(df.sparkSession)
    name, default, ours = BATCH_BYTES
    if df.sparkSession.conf.get(name, default) == default:
        df.sparkSession.conf.set(name, ours)

    def run(batches: Iterable) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield from func(batch)

    return df.mapInArrow(run, schema)


def pieces_of(batch, column: str, most: int = 4 << 20) -> Iterator:
    """Slices of an Arrow batch with about ``most`` bytes in ``column`` each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_bytes(column) -> list:
    """The UTF-8 bytes of a string column; null stays None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: A key of a table that more than one row in so many has is hot: fewer than this many keys are.
HOT_OF = 5_000


def look_up(rows: DataFrame, table: DataFrame, *key: str, count: str = "n_rows") -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once and in ``count`` how many rows hold it.

    Keys with more than one row in ``HOT_OF`` are under ``HOT_OF`` rows of ``table``, whatever its size; they are
    broadcast. No other key is more than that share of a shuffle, so no task depends on the skew of the keys.
    """
    key = list(key)
    total = int(table.agg(F.sum(count)).first()[0] or 0)
    often = (F.col(count) > 1) & (F.col(count) * HOT_OF > total)
    hot, names = table.where(often), [x for x in table.columns if x not in (*key, count)]
    if hot.isEmpty():
        return rows.join(table.select(*key, *names), key)
    near = rows.join(F.broadcast(hot.select(*key, *names)), key)
    far = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return near.unionByName(far.join(table.where(~often).select(*key, *names), key))


def hot_rows(rows: DataFrame, *keys: str) -> DataFrame | None:
    """The values of ``keys`` that more than one row in ``HOT_OF`` of ``rows`` repeat, so fewer than that; None without any."""
    total = rows.count()
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) & (F.col("n_rows") * HOT_OF > total)).select(*keys)
    found = materialise(found, "hot")
    return None if found.isEmpty() else found


def rooted(hooks: DataFrame, name: str) -> DataFrame:
    """The root of every node of a forest (node, to), a root being its own ``to``: each turn halves all ways."""
    while True:
        up = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = materialise(hooks.join(up, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), name)
        hooks = jumped.select("node", "to")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable for every node of ``edges`` (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by pointer
    jumping and contracts. A round at least halves the nodes of each group and a path of n hooks takes
    log2(n) turns, so a long path costs few tables. A hub is never gathered, as the minimum is combined
    before the shuffle. Every step is a written table, so neither the lineage nor the driver holds links.
    """
    both = edges.where("a <> b").select("a", "b")
    links = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = None
    while not links.isEmpty():
        hooks = links.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        hooks = rooted(materialise(hooks, name), name)
        one = links.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        two = one.select(F.col("a2").alias("x"), F.col("b").alias("node")).distinct()
        moved = two.join(hooks, "node").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b")
        links = materialise(moved.distinct(), name)
        if labels is None:
            labels = hooks
        else:
            nxt = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            labels = materialise(labels.join(nxt, "to", "left").select("node", F.coalesce("further", "to").alias("to")), name)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels.select("node", F.col("to").alias("component"))


_encoders: dict = {}


def encoder(path: str, end_id: int):
    """The cached :class:`Encoder` of this Python worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """Ids of words as bytes, encoded when first asked for; two generations bound the memory."""

    MOST = 500_000

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.MOST:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Whole texts to token ids by the ``tokenizers`` library, words that recur encoded once.

    Both vocabularies split a text at white space before they merge, so a single blank or line
    break between two other characters is always a token boundary, and what stands between two
    such places can be encoded alone. Words of letters with a tail of punctuation go straight to
    the library's merging model, other words to its whole tokenizer. A text with any other run of
    white space is encoded in one call.
    """

    TAIL = "!#$%&()*+,-./:;<=>?@[]^_{|}~"

    def __init__(self, path: str, end_id: int):
        import json
        import unicodedata

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.blanks_count = json.loads(Path(path).read_text())["pre_tokenizer"]["type"] == "ByteLevel"
        self.normal = unicodedata.is_normalized
        self.end = np.uint32(end_id).tobytes()
        self.letters = _byte_letters()
        self.stems = Words(self.stem)
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def stem(self, word: str) -> bytes:
        """Ids of what the pre-tokenizer would hand to the model as one word."""
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def word(self, part: str) -> bytes:
        """Ids of a word where white space only parts words and letter case is folded."""
        core = part.rstrip(self.TAIL)
        if core.isalpha() and (core.isascii() or self.normal("NFC", part) and "\u03a3" not in part and "\u0130" not in part):
            return self.stems[core.lower()] + (self.stems[part[len(core) :]] if len(core) < len(part) else b"")
        return self.whole(part)

    def blank_word(self, part: str) -> bytes:
        """Ids of a word with the blank before it, or of a line break and the word after it."""
        lead, bare = (self.line_break, part[1:]) if part[:1] == "\n" else (b"", part)
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise KeyError(part)
        core = bare.rstrip(self.TAIL)
        if core.isalpha():
            return lead + self.stems[core if lead else " " + core] + (self.stems[bare[len(core) :]] if len(core) < len(bare) else b"")
        return self.whole(part if lead else " " + part)

    def encode(self, column):
        """As :meth:`encode_all`, with the garbage collector off: the many small objects hold no cycles."""
        import gc

        was = gc.isenabled()
        gc.disable()
        try:
            return self.encode_all(column)
        finally:
            if was:
                gc.enable()

    def encode_all(self, column):
        """(ids, ends): unsigned 32-bit ids of a string column, each text's followed by the end id, and where each ends.

        Null is as the empty text. Words are looked up once per batch, through Arrow's dictionary.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pc.fill_null(column.cast(pa.string()), "")
        if self.blanks_count:
            cut = pc.binary_join_element_wise("\n", pc.replace_substring(text, "\n", " \n"), "")
        else:
            cut = pc.replace_substring(text, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
        bounds = bounds - bounds[0]
        encode, found, bad = self.blank_word if self.blanks_count else self.word, [], []
        for k, word in enumerate(coded.dictionary.to_pylist()):
            try:
                found.append(encode(word))
            except KeyError:
                bad.append(k)
                found.append(self.line_break)
        found.append(self.end)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), np.uint32)
        wrong = np.unique(np.searchsorted(bounds, np.flatnonzero(np.isin(which, bad)), "right") - 1) if bad else []
        which = np.insert(which, bounds[1:], len(found) - 1)
        bounds = bounds + np.arange(len(bounds))
        length, start = sizes[which], starts[which]
        if self.blanks_count:
            length[bounds[:-1]] -= 1
            start[bounds[:-1]] += 1
        ends = np.cumsum(length)
        ids = flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        ends = ends[bounds[1:] - 1]
        if len(wrong):
            parts, texts = np.split(ids, ends[:-1]), text
            for k in wrong.tolist():
                parts[k] = np.frombuffer(self.whole(texts[k].as_py()) + self.end, np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends
