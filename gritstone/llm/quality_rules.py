"""Quality rules as weak supervision.

Each rule votes a document bad (0) or good (1), or abstains. Documents with equal votes are one
pattern, so the corpus is summed up by at most 3 ** len(RULES) counts, whatever its size. Over
these, expectation-maximisation estimates for every rule how often it votes either way on good
documents and on bad ones, together with the share of good ones. Documents are bad in different ways
that different rules see, so the bad class is a mixture with one part per rule. The posterior
probability of being good decides, in place of passing all rules.

Defined cases: a null text has no words and fails the base; an empty table gives an empty result;
repeated rows are judged alike; columns other than doc_id and text are ignored. Where no document
passes the base, nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, pieces_of, spread

#: name: (count, of which, bad above, good up to); between the two a rule abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.3, 0.02),
    "capitals": ("n_upper", "n_letters", 0.5, 0.15),
    "exclamations": ("n_exclaims", "n_words", 0.3, 0.02),
    "repeated_windows": ("n_repeat_words", "n_words", 0.3, 0.01),
    "adjacent_repeats": ("n_adjacent", "n_words", 0.2, 0.03),
    "no_letters": ("n_no_letter_words", "n_words", 0.2, 0.05),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.4, 0.05),
}
GOOD_FROM = 0.5


def votes(counts: dict):
    """The votes of all rules as one number per document, in base 3: 0 bad, 1 good, 2 abstains."""
    import numpy as np

    counts = counts | {"n_no_letter_words": counts["n_words"] - counts["n_letter_words"]}
    code = np.zeros(len(counts["n_words"]), np.int64)
    for name, of, bad, good in RULES.values():
        share = counts[name] / np.maximum(counts[of], 1)
        code = code * 3 + np.where(counts[of] == 0, 2, np.where(share > bad, 0, np.where(share <= good, 1, 2)))
    return code


def estimate(patterns: dict[int, int], turns: int = 200) -> tuple[dict[int, float], dict]:
    """The posterior probability of being good for each pattern of votes, and what was estimated."""
    import numpy as np

    if not patterns:
        return {}, {}
    codes = np.array(sorted(patterns))
    weight = np.array([patterns[int(c)] for c in codes], float)
    votes = np.stack([codes // 3**k % 3 for k in range(len(RULES))][::-1], axis=1)
    n = len(RULES)
    hits = np.stack([votes == 0, votes == 1], axis=2).astype(float)  # an abstention is no evidence
    # class 0 is good; class k + 1 is bad in the way that rule k sees, other rules as in the corpus
    overall = np.einsum("p,prv->rv", weight, hits) + 0.01
    overall = overall / overall.sum(axis=1, keepdims=True) * 0.98 + 0.01
    table = np.tile(overall, (n + 1, 1, 1))
    table[0] = [0.02, 0.98]
    table[np.arange(n) + 1, np.arange(n)] = [0.95, 0.05]
    share = np.array([0.8, *[0.2 / n] * n])
    for _ in range(turns):
        logs = np.einsum("crv,prv->cp", np.log(table), hits) + np.log(share)[:, None]
        likely = np.exp(logs - logs.max(axis=0))
        likely /= likely.sum(axis=0)
        by_class = likely * weight
        new = (by_class.sum(axis=1) + 0.01) / (weight.sum() + 0.01 * (n + 1))
        table = np.einsum("cp,prv->crv", by_class, hits) + 0.01
        table /= table.sum(axis=2, keepdims=True)
        done, share = np.abs(new - share).max() < 1e-10, new
        if done:
            break
    bad = share[1:] @ table[1:, :, 0] / share[1:].sum()
    rules = {name: {"bad_when_bad": float(bad[k]), "good_when_good": float(table[0, k, 1])} for k, name in enumerate(RULES)}
    return {int(c): float(p) for c, p in zip(codes, likely[0], strict=True)}, {"share_good": float(share[0]), "rules": rules}


def base_failed(counts: dict):
    """Too few words, or over 30 of 100 words in repeated windows."""
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the pattern of votes of every document."""

    def run(batch) -> Iterator:
        import pyarrow as pa

        from .text_stats import stats

        for part in pieces_of(batch, "text"):
            counts = stats(part.column("text"))
            code = votes(counts)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(counts[x], pa.int64()) for x in names], pa.array(base_failed(counts)), pa.array(code)], names=["doc_id", *names, "base_failed", "pattern"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern long"
    return map_batches(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, schema)


def probabilities(counts: DataFrame) -> dict[int, float]:
    """The probability of being good by pattern: at most 3 ** len(RULES) counts reach the driver."""
    patterns = {x["pattern"]: x["count"] for x in counts.where("not base_failed").groupBy("pattern").count().collect()}
    return estimate(patterns)[0]


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, the probability of being good and the verdict ``kept``."""
    counts = materialise(rule_counts(docs), "rules")
    # at most 3 ** len(RULES) rows
    table = docs.sparkSession.createDataFrame(list(probabilities(counts).items()), "pattern long, p_good double")
    judged = counts.join(F.broadcast(table), "pattern", "left")
    kept = ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= GOOD_FROM)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: each is written once with its pattern, and texts are counted once."""

    def run(batch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .text_stats import stats

        for part in pieces_of(batch, "text"):
            counts = stats(part.column("text"))
            code = np.where(base_failed(counts), -1, votes(counts))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(code, pa.int32())], names=["row", "pattern"])

    packed = spread(docs).select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), "text")
    rows = materialise(map_batches(packed, run, f"row {packed.schema['row'].dataType.simpleString()}, pattern int"), "judged")
    patterns = {x["pattern"]: x["count"] for x in rows.where("pattern >= 0").groupBy("pattern").count().collect()}
    kept = sorted(k for k, p in estimate(patterns)[0].items() if p >= GOOD_FROM)
    # at most 3 ** len(RULES) numbers
    return rows.where(F.array_contains(F.array(*map(F.lit, kept)).cast("array<int>"), F.col("pattern"))).select("row.*")
