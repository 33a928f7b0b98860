"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share of all tokens, raised to an exponent between 0 (uniform) and 1 (as it is) and
normalised, is its weight. The exponent is found by bisection, ``ARMS`` ways at a time over the
small table of sources: the largest one whose weights reach a target entropy, or a larger one where
else a source would be repeated more often than a limit. A source's budget is dealt to blocks of
about ``block_docs`` documents by their tokens. A block gives whole epochs of its documents, each a
permutation of its own, and of the last epoch documents in permuted order, as many as its budget
holds: ``TURNS`` times those that fit into what is left are taken up to the first that does not, so
that one long document in their way does not cost the block its budget.

All steps are DataFrame operations. Sources are summed up before the shuffle, and a source with a
third of all rows is as many more blocks, so no task holds more than a block.

Defined cases: a null or blank text has no tokens and is given once per epoch its block reaches, at
least once if the block has no tokens; a null source is a source of its own; rows equal in doc_id,
source and text are one unit that counts as often as it occurs; a null doc_id is allowed; other
columns are ignored by :func:`plan` and kept by :func:`mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread

WORD = r"[^\x20\x09-\x0D]+"
#: Ways and rounds of the bisection: exponents are multiples of ARMS ** -ROUNDS.
ARMS, ROUNDS = 32, 3
#: Times that the last epoch of a block is gone through for documents that still fit.
TURNS = 3


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, n_rows, n_tokens): equal rows together, tokens of all of them."""
    each = spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    return each.groupBy("doc_id", "source", "text_key").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens"))


def exponent(sources: DataFrame, entropy_share: float, most_epochs: float, budget_share: float) -> float:
    """The exponent for ``sources`` (source, tokens), at most ARMS rows to the driver a round.

    Entropy falls and repetition falls as the exponent grows: the answer is the largest exponent
    that reaches ``entropy_share`` of the uniform weights' entropy, or the smallest one that repeats
    no source more than ``most_epochs`` times, whichever is larger.
    """
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"] or total["n"] == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(total["t"]))

    def table(grid: list[int]) -> list:
        a = F.col("step") / F.lit(float(ARMS**ROUNDS))
        raised = some.select(F.explode(F.array(*map(F.lit, grid))).alias("step"), p.alias("p")).withColumn("w", F.pow("p", a))
        summed = raised.groupBy("step").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("l"), F.max(F.col("w") / F.col("p")).alias("e"))
        rows = summed.select("step", (F.log("z") - a * F.col("l") / F.col("z") >= entropy_share * F.log(F.lit(float(total["n"])))).alias("even"), (F.col("e") / F.col("z") * budget_share <= most_epochs).alias("fits"))
        return sorted(rows.collect(), key=lambda x: x["step"])

    def search(holds) -> int:
        """The first of the steps 0 .. ARMS ** ROUNDS where ``holds`` turns true for good."""
        low, width = 0, ARMS**ROUNDS
        while width > 1:
            width //= ARMS
            rows = [x for x in table([low + k * width for k in range(1, ARMS + 1)])]
            first = next((x["step"] for x in rows if holds(x)), low + ARMS * width)
            low = first - width
        return low + 1

    uneven = search(lambda x: not x["even"])
    largest_even = uneven - 1 if uneven < ARMS**ROUNDS or not table([ARMS**ROUNDS])[0]["even"] else uneven
    smallest_fit = 0 if table([0])[0]["fits"] else search(lambda x: x["fits"])
    return max(largest_even, smallest_fit) / ARMS**ROUNDS


def plan(docs: DataFrame, entropy_share: float = 0.97, most_epochs: float = 4.0, budget_share: float = 1.0, block_docs: int = 1024, cover: bool = False) -> DataFrame:
    """One row per unit and epoch it is given in: doc_id, source, n_tokens, n_rows, block, epoch, place.

    The budget is ``budget_share`` times all tokens. With ``cover`` it is instead the least that
    gives the least repeated source one whole epoch, so that every document occurs; the limit on
    epochs then bounds how often the most repeated source occurs against the least repeated one.
    """
    table = materialise(units(docs), "units")
    sources = materialise(table.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    if cover:
        # epochs of a source against those of the largest: (p / p_max) ** (a - 1)
        top = sources.agg(F.max("tokens").alias("a"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("b")).first()
        ratio = (top["a"] or 1) / (top["b"] or 1)
        import math

        alpha = 1.0 if ratio <= 1 else max(0.0, 1 - math.log(most_epochs) / math.log(ratio))
        budget = F.lit(float(top["a"] or 0)) * F.pow(F.col("tokens") / F.lit(float(top["a"] or 1)), F.lit(alpha))
    else:
        alpha = exponent(sources, entropy_share, most_epochs, budget_share)
        z = sources.where("tokens > 0").agg(F.sum(F.pow(share, F.lit(alpha)))).first()[0] or 1.0
        budget = F.pow(share, F.lit(alpha)) / F.lit(z) * F.lit(budget_share * total)
    budgets = materialise(sources.select(F.col("source").alias("of"), F.when(F.col("tokens") > 0, F.floor(budget + 0.5)).otherwise(0).cast("double").alias("budget"), F.col("tokens").alias("source_tokens"), F.ceil(F.col("docs") / block_docs).alias("blocks")), "budgets")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit("block|"), name)), 1, 8), 16, 10).cast("long")
    dealt = table.join(budgets, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", number % F.col("blocks"))
    block = Window.partitionBy("source", "block")
    held = dealt.withColumn("block_tokens", F.sum("n_tokens").over(block))
    given = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens") * F.col("block_tokens") + 0.5)).otherwise(0)
    whole = F.when(F.col("block_tokens") > 0, F.floor(F.col("given") / F.col("block_tokens"))).otherwise(0).cast("long")
    held = held.withColumn("given", given).withColumn("whole", whole)
    shuffled = F.md5(F.concat(F.col("whole").cast("string"), F.lit("|"), name))
    in_turn = block.orderBy("shuffled", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("shuffled", shuffled).withColumn("last", F.lit(False)).withColumn("rest", F.col("given") - F.col("whole") * F.col("block_tokens"))
    for _ in range(TURNS):
        fits = ~F.col("last") & (F.col("n_tokens") <= F.col("rest"))
        held = held.withColumn("running", F.sum(F.when(fits, F.col("n_tokens")).otherwise(0)).over(in_turn)).withColumn("taken", fits & (F.col("running") <= F.col("rest")))
        used = F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0)).over(block)
        held = held.withColumn("rest", F.col("rest") - used).withColumn("last", F.col("last") | F.col("taken"))
    copies = held.withColumn("copies", F.col("whole").cast("int") + F.col("last").cast("int")).where("copies > 0")
    every = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order = Window.partitionBy("source", "block", "epoch").orderBy(F.md5(F.concat(F.col("epoch").cast("string"), F.lit("|"), name)), "text_key")
    return every.select("doc_id", "source", "text_key", "n_tokens", "n_rows", "block", "epoch", F.row_number().over(order).cast("long").alias("place"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`plan` gives it. They travel as one column, so no name can clash."""
    copies = plan(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.count("*").cast("int").alias("copies")).alias("b")
    key = [docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.xxhash64(docs["text"]).alias("text_key")]
    keyed = docs.select(F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row"), *key).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.text_key") == F.col("b.text_key"))
    joined = keyed.join(copies, same)
    return joined.select("a.row", F.explode(F.sequence(F.lit(1), F.col("b.copies")))).select("row.*")
