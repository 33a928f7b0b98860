"""Counts over whole texts, computed for a batch of documents at a time."""

from __future__ import annotations

#: Word length of the windows whose repeats are counted.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_NOT_LETTERS = bytes(x for x in range(256) if x not in _LETTERS and x not in b" \t\n\x0b\x0c\r")


def words_of(column):
    """(word numbers, words, bounds): words parted by ASCII white space, numbered within the batch; null has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
    bounds = bounds - bounds[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = ids != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        ids = ids[keep]
    return ids, coded.dictionary, bounds


def per_text(values, bounds):
    """Sums of ``values`` between bounds; empty ranges give 0."""
    import numpy as np

    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeat_words(ids, bounds, width: int = WINDOW):
    """Per text, the words in windows of ``width`` words (a power of two) that the text has twice or more."""
    import numpy as np
    import pandas as pd

    n = len(ids)
    out = np.zeros(len(bounds) - 1, np.int64)
    if n < width:
        return out
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names, span = ids, 1
    while span < width:
        names = pd.factorize(names[:-span] * np.int64(n + 1) + names[span:])[0].astype(np.int64)
        span *= 2
    inside = doc[: n - width + 1] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    which = pd.factorize(names[at] * np.int64(len(out)) + doc[at])[0]
    many = at[np.bincount(which)[which] > 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, many, 1)
    np.add.at(change, many + width, -1)
    return per_text(np.cumsum(change[:-1]) > 0, bounds)


def stats(column) -> dict:
    """Counts of every text of a string column, by name."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, words, bounds = words_of(column)
    rows = len(bounds) - 1
    text = pc.fill_null(column.cast(pa.string()), "")
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    out = {"n_words": np.diff(bounds), "word_chars": per_text(lengths[ids], bounds)}
    out["n_symbols"] = sum((pc.count_substring(text, x).to_numpy().astype(np.int64) for x in SYMBOLS), np.zeros(rows, np.int64))
    out["n_repeat_words"] = repeat_words(ids, bounds)
    doc = np.repeat(np.arange(rows), np.diff(bounds))
    out["n_adjacent"] = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=rows)
    distinct = np.unique(doc * np.int64(len(words) + 1) + ids) // np.int64(len(words) + 1)
    out["n_distinct"] = np.bincount(distinct, minlength=rows)
    counts = {k: np.zeros(rows, np.int64) for k in ("n_lines", "n_dup_lines", "n_upper", "n_letters", "n_digits", "n_bytes", "n_letter_words", "n_exclaims", "n_stops", "n_commas", "n_ended")}
    for k, raw in enumerate(text.cast(pa.binary()).to_pylist()):
        lines = [x for x in raw.split(b"\n") if x.strip()]
        size = len(raw)
        counts["n_lines"][k], counts["n_dup_lines"][k] = len(lines), len(lines) - len(set(lines))
        counts["n_upper"][k] = size - len(raw.translate(None, _UPPER))
        counts["n_letters"][k] = size - len(raw.translate(None, _LETTERS))
        counts["n_digits"][k] = size - len(raw.translate(None, _DIGITS))
        counts["n_letter_words"][k] = len(raw.translate(None, _NOT_LETTERS).split())
        counts["n_bytes"][k], counts["n_exclaims"][k] = size, raw.count(b"!")
        counts["n_stops"][k], counts["n_commas"][k] = raw.count(b"."), raw.count(b",")
        counts["n_ended"][k] = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return out | counts
