"""Quality classifier: a generalised additive model with pairwise interactions.

Counts over the whole text become features, each cut into at most ``BINS`` bins at quantiles of the
training rows. Boosting goes round the features in turn: each gets a tree of a few leaves, fitted to
the gradient of the logistic loss summed by bin and shrunk, added to the feature's look-up table.
The pairs of features whose quadrants explain most of what is left then get tables over both bins in
the same way. A document's score is the logistic function of an intercept and one addition per
table, done for whole columns at a time.

The model is fitted on the driver to a bounded sample of labelled rows: at most ``SAMPLE`` of them,
those whose hash of doc_id is below a threshold. Held-out rows (crc32 of the doc_id as text, modulo 4, is
2) are never among them. Everything else runs over all documents.

Defined cases: a null text is an empty one and gets a score; a null doc_id is never a training row
and is not held out; labels that repeat a doc_id count as their largest; without labels every score
is 0.5, with labels of one kind it leans to that kind; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_batches, materialise, pieces_of, ship, spread

#: Labelled rows to fit on, at most; bins of a feature and of a feature within a pair.
SAMPLE, BINS, PAIR_BINS = 40_000, 48, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 150, 60, 0.15, 4, 6
GOOD_FROM = 0.7

#: (count, of which): features are ratios of counts; the first two are a length and a mean.
RATIOS = [
    ("n_symbols", "n_words"), ("n_upper", "n_letters"), ("n_exclaims", "n_words"), ("n_repeat_words", "n_words"),
    ("n_adjacent", "n_words"), ("n_distinct", "n_words"), ("n_letter_words", "n_words"), ("n_dup_lines", "n_lines"),
    ("n_digits", "n_bytes"), ("n_stops", "n_words"), ("n_commas", "n_words"), ("n_ended", "n_lines"), ("n_lines", "n_words"), ("n_letters", "n_bytes"),
]


def features(counts: dict):
    """A row of features for each document."""
    import numpy as np

    ratio = lambda a, b: counts[a] / np.maximum(counts[b], 1)
    return np.stack([np.log1p(counts["n_words"]), ratio("word_chars", "n_words"), *[ratio(a, b) for a, b in RATIOS]], axis=1)


def _tree(gradient, weight, leaves: int):
    """Values by bin of a tree with at most ``leaves`` leaves, grown where the gain is largest."""
    import numpy as np

    values = np.zeros(len(gradient))
    spans = [(0, len(gradient))]

    def best(span):
        a, b = span
        if b - a < 2:
            return 0.0, a
        g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b]) + 1.0
        total_g, total_w = g[-1], w[-1]
        gain = g[:-1] ** 2 / w[:-1] + (total_g - g[:-1]) ** 2 / (total_w - w[:-1] + 1.0) - total_g**2 / total_w
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    while len(spans) < leaves:
        gains = [best(x) for x in spans]
        k = max(range(len(spans)), key=lambda i: gains[i][0])
        if gains[k][0] <= 1e-9:
            break
        a, b = spans.pop(k)
        spans += [(a, gains[k][1]), (gains[k][1], b)]
    for a, b in spans:
        values[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1.0)
    return values


def _quadrants(gradient, weight):
    """(gain, values) of the best cut of a grid into four quadrants."""
    import numpy as np

    g, w = np.cumsum(np.cumsum(gradient, 0), 1), np.cumsum(np.cumsum(weight, 0), 1)
    n, m = gradient.shape
    gs = [g[:-1, :-1], g[:-1, -1:] - g[:-1, :-1], g[-1:, :-1] - g[:-1, :-1], g[-1, -1] - g[:-1, -1:] - g[-1:, :-1] + g[:-1, :-1]]
    ws = [w[:-1, :-1], w[:-1, -1:] - w[:-1, :-1], w[-1:, :-1] - w[:-1, :-1], w[-1, -1] - w[:-1, -1:] - w[-1:, :-1] + w[:-1, :-1]]
    gain = sum(a**2 / (b + 1.0) for a, b in zip(gs, ws, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.empty((n, m))
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, m)), (slice(i + 1, n), slice(0, j + 1)), (slice(i + 1, n), slice(j + 1, m)))):
        values[rows, columns] = gs[k][i, j] / (ws[k][i, j] + 1.0)
    return float(gain[i, j]), values


def fit(x, y) -> dict:
    """The model for features ``x`` and labels ``y``: cuts, tables, pairs and an intercept."""
    import numpy as np

    if not len(y):
        return {"intercept": 0.0, "cuts": [], "tables": [], "pairs": []}
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    coarse = [c[np.unique(np.linspace(0, len(c) - 1, min(len(c), PAIR_BINS - 1)).astype(int))] for c in cuts]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    wide = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), intercept)

    def slope():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, w = slope()
            step = RATE * np.clip(_tree(np.bincount(b, g, len(tables[k])), np.bincount(b, w, len(tables[k])), LEAVES), -4, 4)
            tables[k] += step
            total += step[b]
    g, w = slope()

    def grid(i, j, values):
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[i] * m + wide[j], values, n * m).reshape(n, m)

    every = [(i, j) for i in range(len(cuts)) for j in range(i) if len(coarse[i]) and len(coarse[j])]
    ranked = sorted(every, key=lambda ij: -_quadrants(grid(*ij, g), grid(*ij, w))[0])[:PAIRS]
    pairs = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in pairs.items():
            g, w = slope()
            step = RATE * np.clip(_quadrants(grid(i, j, g), grid(i, j, w))[1], -4, 4)
            table += step
            total += step[wide[i], wide[j]]
    return {"intercept": intercept, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": [(i, j, t) for (i, j), t in pairs.items()]}


def score(model: dict, x):
    """The probability of label 1 for each row of features."""
    import numpy as np

    total = np.full(len(x), model["intercept"])
    for k, (cut, table) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        total += table[np.searchsorted(cut, x[:, k], "right")]
    for i, j, table in model["pairs"]:
        total += table[np.searchsorted(model["coarse"][i], x[:, i], "right"), np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every document."""

    def run(batch) -> Iterator:
        import pyarrow as pa

        from .text_stats import stats

        for part in pieces_of(batch, "text"):
            x = features(stats(part.column("text")))
            rows = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "features"])

    return map_batches(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, "doc_id long, features array<double>")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, learnt from ``labels``."""
    import numpy as np

    spark = docs.sparkSession
    rows = materialise(feature_rows(docs), "features")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = materialise(rows.join(known, "doc_id").where(part != 2), "marked")
    train = sorted(hash_sample(marked, sample, "doc_id").select("doc_id", "features", "quality").collect())
    x = np.array([r["features"] for r in train], float).reshape(len(train), 2 + len(RATIOS))
    model = fit(x, np.array([r["quality"] for r in train], float))
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batch) -> Iterator:
        import pyarrow as pa

        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(held.value, x))], names=["doc_id", "score"])

    scored = map_batches(rows, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
