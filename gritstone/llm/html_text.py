"""Main text of web pages by markup and nearest-URL page differencing.

A page is parsed into blocks of text in page order, each with what the markup says of it: furniture
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments), a name that may mean
furniture but need not, article text, or nothing. Pages of a host are put in order of their URL path,
and each is paired with the nearest page before or after it that is not the same page again, the one
whose path shares more leading segments. The pair's lines are aligned by longest common subsequence,
and lines that both have are the host's template and deleted. The markup is a prior: furniture goes
and article text stays, as passages that two articles share are no template; differencing decides
all that the markup leaves open, on every page: blocks without marks, and blocks whose name is
ambiguous, in an article or out of it. Only where no neighbour has other lines does markup, if
there is any, decide alone.

Pages are dealt out by ranges of (host, path), so that a host with a third of all pages spreads over
many tasks. A table of keys alone tells for each range which pages of other ranges are the nearest
ones of its first and last page; these also go there, as partners only. The result is thus the same
for every number of ranges. A range streams by in order, so its size bounds no memory.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; rows with
the same html are the same page again, whether or not their URLs are equal, and each gets its text;
where the nearest page has the same lines in other markup, it tells nothing; unclosed or broken
markup is read as far as it goes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_PARTITIONS, map_batches, materialise, ship, spread

#: Elements that hold no text of the page; that are furniture; that hold the article; that end a block.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "title"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset"}
ARTICLE = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "acronym"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Parts of a name (class, id or role) that say furniture wherever they stand.
CLEAR = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comments?|cookies?|disqus|masthead|nav|navbar|navigation|newsletter|popup|sidebar|signup|sponsor\w*|subscribe|toolbar|consent|contentinfo|complementary)(?:$|[\s_-])", re.IGNORECASE)
#: Words that say so outside an article, and only as a whole name; anything else with such a part is open.
OPEN = re.compile(r"(?:^|[\s_-])(?:banner|footer|header|menu|notice|promo\w*|related|replies|respond|search|share|sharing|social|widget)(?:$|[\s_-])", re.IGNORECASE)
#: What a block is: furniture, of an open name, article text (or open within it), nothing of these.
FURNITURE_BLOCK, OPEN_BLOCK, ARTICLE_BLOCK, OPEN_IN_ARTICLE, PLAIN_BLOCK = range(5)
#: Pages of a range on average.
EACH = 2_000


def name_level(marks: dict) -> int:
    """What the names of an element say: 2 furniture, 1 a word that is so as a whole name, 0.5 a part of one, 0 nothing."""
    found = 0
    for x in ("class", "id", "role"):
        text = marks.get(x) or ""
        if text and CLEAR.search(text):
            return 2
        if text and OPEN.search(text):
            found = max(found, 1 if any(OPEN.fullmatch(w) for w in text.split()) else 0.5)
    return found


class Blocks(HTMLParser):
    """Collects (text, kind) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, int]] = []
        self.silent = self.furniture = self.article = self.open = 0
        self.parts: list[str] = []
        self.found: list[tuple[str, int]] = []

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            kind = FURNITURE_BLOCK if self.furniture else (OPEN_IN_ARTICLE if self.open else ARTICLE_BLOCK) if self.article else OPEN_BLOCK if self.open else PLAIN_BLOCK
            self.found.append((text, kind))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in INLINE or tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            if tag == "hr":
                self.close_block()
            if tag in VOID:
                return
        else:
            self.close_block()
        marks = dict(attrs)
        named = 0 if tag in ("html", "body", *ARTICLE) else name_level(marks)
        hidden = "hidden" in marks or (marks.get("aria-hidden") or "") == "true" or "display:none" in (marks.get("style") or "").replace(" ", "")
        inner = tag == "header" and self.article > 0
        furniture = tag in FURNITURE and not inner or named == 2 or named == 1 and not self.article
        level = (tag in SILENT or hidden, furniture, tag in ARTICLE, 0 < named < 2 and not furniture)
        if tag in INLINE and not any(level):
            return
        if any(level):
            self.close_block()
        self.count(level, 1)
        self.stack.append((tag, *level))

    def count(self, level, by: int) -> None:
        self.silent, self.furniture = self.silent + by * level[0], self.furniture + by * level[1]
        self.article, self.open = self.article + by * level[2], self.open + by * level[3]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.close_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.close_block()
                for _, *level in self.stack[k:]:
                    self.count(level, -1)
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def blocks(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page: (text, kind)."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.found


def shared(one: list, two: list) -> list[bool]:
    """Which items of ``one`` are in a longest common subsequence with ``two``, by bit-parallel rows."""
    start = 0
    while start < min(len(one), len(two)) and one[start] == two[start]:
        start += 1
    stop = 0
    while stop < min(len(one), len(two)) - start and one[len(one) - 1 - stop] == two[len(two) - 1 - stop]:
        stop += 1
    out = [True] * start + [False] * (len(one) - start - stop) + [True] * stop
    a, b = one[start : len(one) - stop], two[start : len(two) - stop]
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows, row = [], full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # a zero bit in a row is a step up of the common length; walk back from the end
    j = len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        zero = ~rows[i] & ((1 << (j + 1)) - 1)
        if not zero:
            continue
        top = zero.bit_length() - 1
        zero_above = ~above & ((1 << (j + 1)) - 1)
        if zero_above.bit_count() < zero.bit_count():
            # this item lengthens the sequence: it pairs with its last place up to the top step
            hits = places.get(a[i], 0) & ((1 << (j + 1)) - 1) if top <= j else 0
            place = hits.bit_length() - 1
            while hits and (~above & ((1 << place) - 1)).bit_count() < zero.bit_count() - 1:
                hits &= ~(1 << place)
                place = hits.bit_length() - 1
            out[start + i] = True
            j = place - 1
    return out


def likeness(one: str, two: str) -> tuple[int, int]:
    """Leading path segments and characters that two paths share."""
    a, b = re.split(r"[/?#]", one), re.split(r"[/?#]", two)
    segments = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    letters = next((k for k, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), min(len(one), len(two)))
    return segments, letters


def main_text(own: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The page's text, given its blocks and those of the page it is paired with."""
    template = shared([x[0] for x in own], [x[0] for x in other]) if other else [False] * len(own)
    in_article = any(kind in (ARTICLE_BLOCK, OPEN_IN_ARTICLE) for _, kind in own)
    kept = []
    for (text, kind), common in zip(own, template, strict=True):
        if kind == ARTICLE_BLOCK or kind == OPEN_IN_ARTICLE and not common:
            kept.append(text)
        elif kind == PLAIN_BLOCK and not common and (other or not in_article):
            kept.append(text)
        elif kind == OPEN_BLOCK and not common and other and not in_article:
            kept.append(text)
    return "\n\n".join(kept)


def partner(page: str, lines: list[str], near: list) -> int | None:
    """Which of ``near`` (path, lines) a page is paired with: of those with other lines, the likest, the first of equals."""
    some = [k for k, x in enumerate(near) if x[1] and x[1] != lines]
    return max(some, key=lambda k: (likeness(page, near[k][0]), -k), default=None)


#: What puts pages in order; ``copy`` is a hash of the html.
KEY = ["host", "path", "page", "url_text", "copy"]


def with_keys(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with the columns of ``KEY``; the path keeps query and fragment behind it."""
    bare = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.substring_index(bare, "/", 1)
    return pages.withColumns({
        "host": F.coalesce(F.lower(host), F.lit("\0")), "path": F.coalesce(F.substring(bare, F.length(host) + 2, F.length(bare)), F.lit("")),
        "page": F.coalesce("page_id", F.lit(-(1 << 63))), "url_text": F.coalesce("url", F.lit("")), "copy": F.xxhash64(F.coalesce("html", F.lit(""))),
    })


def ranges_of(keys: DataFrame, each: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """(first key of every range, the ranges that a page of another range goes to as a partner): a few keys a range.

    For the first page of a range that is the nearest page before it with other html; for its last page, after it.
    """
    keys = materialise(keys, "keys")
    parts = max(1, min(MOST_PARTITIONS, -(-keys.count() // each)))
    dealt = materialise(keys.repartitionByRange(parts, *KEY).withColumn("range", F.spark_partition_id()), "pagekeys")
    key = F.struct(*KEY)
    ends = materialise(dealt.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last")), "pageends")
    # as many rows as there are ranges
    inner = dealt.join(F.broadcast(ends), "range").groupBy("range").agg(
        F.first("first").alias("first"), F.first("last").alias("last"),
        F.min(F.when(F.col("copy") != F.col("first.copy"), key)).alias("second"), F.max(F.when(F.col("copy") != F.col("last.copy"), key)).alias("other"),
    )
    rows = sorted(([tuple(x[c]) if x[c] else None for c in ("first", "last", "second", "other")] for x in inner.collect()), key=lambda x: x[0])
    wanted: dict[tuple, list[int]] = {}

    def sweep(order, border: int, inner: int, far: int, far_other: int) -> None:
        """Hold the nearest page passed, and the nearest one with other html than that."""
        one = two = None
        for k in order:
            x = rows[k]
            found = one if one and one[-1] != x[border][-1] else two
            if found and found[0] == x[border][0]:
                wanted.setdefault(found, []).append(k)
            two = x[far_other] or (one if one and one[-1] != x[far][-1] else two)
            one = x[far]

    sweep(range(len(rows)), 0, 2, 1, 3)
    sweep(range(len(rows) - 1, -1, -1), 1, 3, 0, 2)
    return [x[0] for x in rows], wanted


def extract(pages: DataFrame, each: int = EACH) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    spark = pages.sparkSession
    pages = with_keys(pages.select(F.col("page_id").cast("long"), "url", "html"))
    held = spark.sparkContext.broadcast(ranges_of(pages.select(*KEY), each))

    def parse(batch) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        firsts, wanted = held.value
        keys = list(zip(*(batch.column(x).to_pylist() for x in KEY), strict=True))
        row, place, guest = [], [], []
        for k, key in enumerate(keys):
            own = max(0, bisect_right(firsts, key) - 1)
            for r in (own, *wanted.get(key, ())):
                row.append(k)
                place.append(r)
                guest.append(len(guest) > 0 and row[-2:] == [k, k])
        found = [[{"text": t, "kind": kind} for t, kind in blocks(x)] for x in batch.column("html").to_pylist()]
        lines = pa.array(found, pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8())])))
        out = pa.RecordBatch.from_arrays([*[batch.column(x) for x in (*KEY, "page_id", "url")], lines], names=[*KEY, "page_id", "url", "lines"]).take(pa.array(row))
        yield out.append_column("range", pa.array(place, pa.int32())).append_column("guest", pa.array(guest))

    def difference(batches: Iterable) -> Iterator:
        """Pages stream by in order; equal ones that follow each other are settled when their successor is known."""
        import pyarrow as pa

        done: list[tuple] = []

        def settle(before, run, after) -> None:
            near = [x for x in (before, after) if x and x["place"] == run["place"]]
            texts: dict = {}
            for (page_id, url, path), n in run["pages"]:
                k = partner(path, run["lines"], [(x["last" if x is before else "path"], x["lines"]) for x in near])
                if k not in texts:
                    texts[k] = main_text(run["blocks"], near[k]["blocks"] if k is not None else None)
                done.extend([(page_id, url, texts[k])] * n)

        def rows():
            texts = [x[2] for x in done]
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
            done.clear()
            return out

        before = run = None
        for batch in batches:
            for x in batch.to_pylist():
                same = run and run["copy"] == (x["range"], x["host"], x["copy"])
                if not same:
                    found = [(b["text"], b["kind"]) for b in x["lines"]]
                    new = {"place": (x["range"], x["host"]), "copy": (x["range"], x["host"], x["copy"]), "path": x["path"], "blocks": found, "lines": [b[0] for b in found], "pages": []}
                    if run:
                        settle(before, run, new)
                    before, run = run, new
                run["last"] = x["path"]
                if not x["guest"]:
                    page = (x["page_id"], x["url"], x["path"])
                    if run["pages"] and run["pages"][-1][0] == page:
                        run["pages"][-1] = (page, run["pages"][-1][1] + 1)
                    else:
                        run["pages"].append((page, 1))
                if len(done) >= 500:
                    yield rows()
        if run:
            settle(before, run, None)
        if done:
            yield rows()

    ship(spark)
    kind = "host string, path string, page long, url_text string, copy long, page_id long, url string, lines array<struct<text:string,kind:tinyint>>, range int, guest boolean"
    parsed = map_batches(spread(pages), parse, kind).drop("page", "url_text")
    names = ["page_id", "url"]
    dealt = parsed.repartitionById(max(1, len(held.value[0])), "range").sortWithinPartitions("range", "host", "path", *names, "copy")
    return dealt.mapInArrow(difference, "page_id long, url string, text string, n_chars long")
