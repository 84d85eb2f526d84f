"""URL filters: rules first, and for the rest a character language-model ratio.

Two variable-order Markov models read characters: one of the URLs that rules accept, one
of those they reject. A character's probability after its context of up to ``order``
characters mixes the counts of every shorter context (Witten-Bell: a context with many
different successors trusts its shorter one more; an unseen one leaves all to it). A URL's
score is the mean over its characters of the difference of the two logarithms. A fifth of
the judged URLs is kept back from a second pair of counts and sets the limit.

Everything is built-in expressions. Each distinct URL counts once. Counts are folded by
window of characters before they are shuffled, shorter windows come from longer ones,
and the log ratio is worked out once per distinct window; URLs meet it by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.session import cut_lineage, release, spread

#: Characters of context, at most.
ORDER = 5
#: Log ratios are whole multiples of 1 / UNIT, so that sums do not depend on an order; scores are in 1 / STEPS.
UNIT, STEPS = 1 << 24, 256
#: One judged URL in so many sets the limit instead of being counted with the rest.
KEPT_BACK = 5
START, END = "\x02", "\x03"
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str]


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """What is between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; and from there to ``?`` or ``#``. Both empty without ``://``."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substring(u, F.locate("://", u) + 3, F.char_length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    Rules are (verdict, host/path): the host and all its subdomains, and paths that start
    with the rule's. Of equally long ones the first in the list wins.
    """
    name = verdict = None
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def windows(text: Column, order: int = ORDER) -> Column:
    """A window of ``order`` characters and the next one for each character of the text and for its end."""
    chars = F.concat(F.array_repeat(F.lit(START), order), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(END)))
    whole = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - order), lambda i: F.array_join(F.slice(c, i, order + 1), "")))
    return F.element_at(whole, 1)


def window_ratios(counts: DataFrame, pairs: tuple[tuple[str, str], ...], order: int = ORDER) -> DataFrame:
    """(gram, ratio of each pair): log P(last character | the others) under the first of a pair of counts less that under the second, in 1 / UNIT.

    ``counts`` has gram (windows of ``order`` + 1 characters, each once) and the count columns.
    """
    names = [c for pair in pairs for c in pair]
    levels = [counts.select("gram", *names)]
    for k in range(order, 0, -1):  # windows of k characters: those of k + 1 without their first
        levels.append(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*[F.sum(c).alias(c) for c in names]))
    below = None
    for k, level in enumerate(reversed(levels)):
        # A context has no more successors than there are characters.
        context = Window.partitionBy("context")
        seen = level.withColumn("context", F.substring("gram", 1, k))
        seen = seen.select("gram", *names, *[F.sum(c).over(context).alias(f"n_{c}") for c in names], *[F.count(F.when(F.col(c) > 0, 1)).over(context).alias(f"t_{c}") for c in names], F.count("*").over(context).alias("letters"))
        if below is None:
            shorter = seen.withColumns({f"p_{c}": F.lit(1.0) / F.col("letters") for c in names})
        else:
            shorter = seen.withColumn("short", F.substring("gram", 2, k)).join(spread(below.select(F.col("gram").alias("short"), *[f"p_{c}" for c in names])), "short")

        def mixed(c: str) -> Column:
            n, t, p = F.col(f"n_{c}"), F.col(f"t_{c}"), F.col(f"p_{c}")
            return F.when(n == 0, p).otherwise((F.col(c) + t * p) / (n + t))

        below = shorter.select("gram", *[mixed(c).alias(f"p_{c}") for c in names])
    return below.select("gram", *[F.round((F.log(f"p_{a}") - F.log(f"p_{b}")) * UNIT).cast("bigint").alias(f"ratio_{a}") for a, b in pairs])


def limit_of(scores: DataFrame) -> DataFrame:
    """One row (limit): the score from which on URLs pass, set on judged URLs (score, verdict).

    It has the smallest share of accepted URLs below plus share of rejected URLs not below;
    of equal ones it is the nearest to 0, then the smaller. Without URLs of both kinds it is 0.
    """
    steps = scores.groupBy("score").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in (ALLOW, BLOCK)])
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # scores are whole numbers in a fixed range
    every = Window.partitionBy()
    total = {v: F.sum(v).over(every) for v in (ALLOW, BLOCK)}
    below = {v: F.coalesce(F.sum(v).over(upto), F.lit(0)) for v in (ALLOW, BLOCK)}
    wrong = below[ALLOW] * total[BLOCK] + (total[BLOCK] - below[BLOCK]) * total[ALLOW]
    judged = steps.select("score", wrong.alias("wrong"), ((total[ALLOW] > 0) & (total[BLOCK] > 0)).alias("both"))
    return judged.where("both").agg(F.coalesce(F.min(F.struct("wrong", F.abs("score"), "score"))["score"], F.lit(0)).alias("limit"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", keep: tuple[str, ...] = ("page_id",), order: int = ORDER) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict and score (null where a rule decides), one row per row of ``pages``.

    The rule's verdict, else ``allow`` where the score reaches the limit. A null URL is
    an empty one, without host and path: its score is that of an end alone. Without URLs
    accepted and URLs rejected by rules nothing tells them apart: the score is 0 and every
    URL passes. Equal URLs get equal verdicts; an empty table gives an empty one. Other
    columns are not read; a kept column named like a result raises an error.
    """
    clash = {"host", "path", "rule", "verdict", "score"} & set(keep)
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(url)
    placed = pages.select(*keep, text.alias("__url"), host.alias("host"), path.alias("path"))
    placed = placed.select("*", *[c.alias(n) for c, n in zip(fitting_rule(F.col("host"), F.col("path"), rules), ("rule", "__ruled"))])

    back = F.crc32(F.col("__url").cast("binary")) % KEPT_BACK == 0
    urls = placed.groupBy("__url").agg(F.first("__ruled").alias("verdict")).withColumn("kept_back", F.col("verdict").isNotNull() & back)
    urls = cut_lineage(urls.withColumn("row", F.monotonically_increasing_id()))
    each = urls.select("row", "verdict", "kept_back", F.explode(windows(F.col("__url"), order)).alias("gram"))
    sums = {f"{v}_{s}": F.count(F.when((F.col("verdict") == v) & some, 1)) for v in (ALLOW, BLOCK) for s, some in (("all", F.lit(True)), ("part", ~F.col("kept_back")))}
    counts = cut_lineage(each.groupBy("gram").agg(*[c.alias(n) for n, c in sums.items()]))
    ratios = cut_lineage(window_ratios(counts, (("allow_all", "block_all"), ("allow_part", "block_part")), order))

    # A judged URL is scored by counts without it, one without a rule by all counts.
    # The planner sees the files of the URLs only, not the many windows made of them, so it would broadcast either side.
    asked = each.where("verdict is null or kept_back").join(spread(ratios), "gram")
    ratio = F.when(F.col("kept_back"), F.col("ratio_allow_part")).otherwise(F.col("ratio_allow_all"))
    mean = F.floor(F.sum(ratio) / (F.count("*") * (UNIT // STEPS))).cast("bigint")
    scored = cut_lineage(asked.groupBy("row").agg(mean.alias("score")).join(spread(urls), "row").select("__url", "verdict", "score"))
    limit = limit_of(scored.where("verdict is not null")).first()["limit"]
    release(counts, ratios)

    ruled = placed.where("__ruled is not null").select(*keep, "host", "path", "rule", F.col("__ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    found = scored.where("verdict is null").select("__url", "score")
    rest = placed.where("__ruled is null").join(spread(found), "__url")
    verdict = F.when(F.col("score") >= limit, ALLOW).otherwise(BLOCK)
    return ruled.unionByName(rest.select(*keep, "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / STEPS).alias("score")))
