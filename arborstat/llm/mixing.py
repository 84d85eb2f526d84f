"""Temperature mixing: sources brought to target weights and realised as permuted blocks.

A source's weight is its token share to the power of an exponent between 0 (all sources
alike) and 1 (as they are). The exponent is bisected until the mix meets a target entropy
or a repetition limit. Weights times the token budget say how many whole passes over a
source are taken and which part of one more; documents are dealt to blocks, the blocks of
each pass are permuted, and the last pass ends where the budget does.

Hot sources have many blocks, so nothing is gathered per source but sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.llm.common import refuse_clash, whole_text
from arborstat.session import cut_lineage, release

BLOCK_TOKENS = 65_536
#: Blocks whose running total one task makes, about.
RUN = 4096
#: Each pass over the sources settles so many halvings; 32 in all.
LEVELS, PASSES = 4, 8
#: Quotients this close below a whole number count as whole.
NUDGE = 1e-9


def digest(*parts) -> Column:
    """60 bits of the md5 digest of the parts, joined by colons; a null part counts as empty."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def exponent(sources: DataFrame, budget: float | None, entropy: float | None, max_repeats: float | None) -> tuple[float, float, float]:
    """The exponent, the sum of powers it makes, and the budget, of ``sources`` (share > 0, tokens).

    ``entropy`` is a part of the largest one (log of the number of sources): the exponent
    is the largest that reaches it. ``max_repeats``: the smallest with which no source is
    read more often. An unreachable target gives the nearest end (0 or 1). Without a
    ``budget``, it is what takes every source once at least.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")

    def measures(points: list[float]) -> list[tuple[float, float, float, float, int, float]]:
        aggs = []
        for a in points:
            power = F.pow("share", F.lit(a))
            aggs += [F.sum(power), F.sum(power * F.log("share")), F.max(power / F.col("share")), F.min(power / F.col("share"))]
        row = sources.agg(F.count("*"), F.sum("tokens"), *aggs).first()
        return [(*row[2 + 4 * i : 6 + 4 * i], row[0], float(row[1] or 0)) for i in range(len(points))]

    def repeats(x) -> float:
        z, _, most, least, _, total = x
        return (most / least) if budget is None else budget / total * most / z

    def high_enough(a: float, x) -> bool:
        """Whether the exponent sought is not above (entropy) or is above (repeats) ``a``: true on the upper side."""
        z, logs, _, _, n, _ = x
        if entropy is not None:
            import math

            return math.log(z) - a * logs / z < entropy * math.log(n)
        return repeats(x) <= max_repeats

    at_zero, at_one = measures([0.0, 1.0])
    if not at_zero[4]:
        return 1.0, 1.0, 0.0
    lo, hi = 0.0, 1.0
    if entropy is not None and not high_enough(1.0, at_one):
        lo = 1.0
    elif entropy is not None and high_enough(0.0, at_zero):
        hi = 0.0
    elif entropy is None and high_enough(0.0, at_zero):
        hi = 0.0
    elif entropy is None and not high_enough(1.0, at_one):
        lo = 1.0
    for _ in range(PASSES if lo < hi else 0):
        n = 1 << LEVELS
        points = [lo + (hi - lo) * k / n for k in range(1, n)]
        above = [high_enough(a, x) for a, x in zip(points, measures(points))]
        k = above.index(True) if True in above else n - 1
        lo, hi = ([lo, *points][k], [*points, hi][k])
    # Entropy holds on the lower side, the repetition limit on the upper one.
    found = lo if entropy is not None or lo == 1.0 else hi
    z, _, _, least, _, total = measures([found])[0]
    return found, z, float(budget) if budget is not None else total * z / least


def mix(
    docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | str = "all", block_tokens: int = BLOCK_TOKENS, seed: int = 1,
    source: str = "source", doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, str] = ("epoch", "mix_order"),
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, plus epoch (int, from 0) and mix_order (double), named as ``outputs`` says.

    Tokens are words. ``budget``: tokens to take; "all": as many as there are; "cover": as
    many as take every source once at least, so that no document is left out. Sorting by
    mix_order deals all sources out evenly, block by block. Each source's tokens stay
    within its budget, short of it by less than the documents of one place (one, or all that share a doc_id).

    A null source is a source of its own; null texts have no tokens. A source without any
    tokens has no weight and is taken once. Rows that repeat a doc_id share a place in the
    permutation and are taken or left together. An empty table gives an empty one. Columns
    named like the outputs end in a ValueError, all others are carried along whatever their names.
    """
    columns = docs.columns
    refuse_clash(columns, outputs)
    # Inside, given columns go by number, so that none of them meets one of the mix.
    docs = docs.toDF(*[f"__given{i}" for i in range(len(columns))])
    source, doc_id, text = (f"__given{columns.index(c)}" for c in (source, doc_id, text))
    at = digest(F.col(doc_id), seed)
    rows = docs.withColumns({"__source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), "__tokens": words(text), "__at": at, "__in": digest(F.col(doc_id), seed, "in")})
    slim = cut_lineage(rows.select("__source", "__tokens", "__at", "__in"))
    sums = cut_lineage(slim.groupBy("__source").agg(F.sum("__tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = cut_lineage(sums.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))))
    alpha, z, budget = exponent(shares, {"all": float(total), "cover": None}[budget] if isinstance(budget, str) else float(budget), entropy, max_repeats)

    times = F.pow("share", F.lit(alpha)) / F.lit(z) * F.lit(budget) / F.col("tokens")
    plan = sums.join(shares.select("__source", "share"), "__source", "left").withColumn("times", F.coalesce(times, F.lit(1.0)))
    plan = plan.withColumn("epochs", F.floor(F.col("times") + NUDGE)).withColumn("rest", F.greatest(F.lit(0.0), F.col("times") - F.col("epochs")) * F.col("tokens"))
    plan = cut_lineage(plan.select("__source", "times", "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).alias("blocks")))

    block = (F.col("__at") % F.col("blocks")).alias("block")
    turn = digest(F.col("__source"), F.col("block"), F.col("epochs"), seed)
    dealt = slim.join(plan, "__source")
    blocks = dealt.groupBy("__source", block).agg(F.sum("__tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    blocks = blocks.withColumn("turn", turn).withColumn("run", F.floor(F.col("turn") / F.lit(2.0**60) * F.ceil(F.col("blocks") / RUN)))
    blocks = cut_lineage(blocks)
    # Running totals in two steps: over runs of blocks, then inside each run.
    before = Window.partitionBy("__source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("__source", "run").agg(F.sum("tokens").alias("sum")).select("__source", "run", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("__source", "run").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.join(runs, ["__source", "run"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(inside))
    ends = cut_lineage(ends.select("__source", "block", "epochs", (F.col("upto") <= F.col("rest")).alias("full"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")))

    # The block in which the budget ends: its documents in their own order, as far as they fit.
    last = ends.where("not full and room > 0").select("__source", "block", "room")
    lone = dealt.withColumn("block", F.col("__at") % F.col("blocks")).join(last, ["__source", "block"]).groupBy("__source", "block", "__in").agg(F.sum("__tokens").alias("tokens"), F.first("room").alias("room"))
    so_far = F.sum("tokens").over(Window.partitionBy("__source", "block").orderBy("__in"))
    cut = lone.withColumn("so_far", so_far).where("so_far <= room").groupBy("__source", "block").agg(F.max("__in").alias("cut"))
    decided = cut_lineage(ends.join(cut, ["__source", "block"], "left").select("__source", "block", "full", "cut"))
    release(slim, sums, shares, blocks, ends)

    more = F.when(F.col("full") | (F.col("__in") <= F.col("cut")), 1).otherwise(0)
    taken = rows.join(plan.select("__source", "times", "epochs", "blocks"), "__source").withColumn("block", F.col("__at") % F.col("blocks")).join(decided, ["__source", "block"])
    copies = (F.col("epochs") + more).cast("int")
    order = (F.col("epoch") + digest(F.col("__source"), F.col("block"), F.col("epoch"), seed) / F.lit(2.0**60)) / F.col("times")
    each = taken.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    given = [F.col(d).alias(c) for d, c in zip(docs.columns, columns)]
    return each.select(*given, F.col("epoch").alias(outputs[0]), order.alias(outputs[1]))


def in_order(mixed: DataFrame, seed: int = 1, doc_id: str = "doc_id", order: str = "mix_order") -> DataFrame:
    """The rows of :func:`mix` in its order: by mix_order, inside a block by the documents' own places."""
    rest = [c for c in mixed.columns if c != order]
    return mixed.orderBy(order, digest(F.col(doc_id), seed, "in"), doc_id, F.xxhash64(*rest))
