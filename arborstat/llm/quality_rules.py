"""Quality rules as a short-circuit cascade, on built-in expressions only.

Every rule is a condition that rejects a text. On a sample each rule's cost (seconds) and
the share of rows it rejects are measured; the cascade asks the rules in the order of
rejection per cost and stops at the first that rejects. The order decides the work, never
the result: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.llm.common import bind, refuse_clash, whole_text
from arborstat.session import cut_lineage, release

#: Rows on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def n_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(WORD)).cast("bigint")


def n_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern)).cast("bigint")


def word_chars(t: Column) -> Column:
    return F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("bigint")


def n_symbols(t: Column) -> Column:
    return (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("bigint")


def lines(t: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(t: Column) -> Column:
    return bind(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(t: Column, n: int = 3) -> Column:
    """Words inside ``n``-word windows that occur twice or more, the first occurrence included.

    The windows are sorted with their places; equal neighbours are repeats. Places in
    order, each covers ``n`` words or as many as there are to the next.
    """

    def same(x: Column, y: Column) -> Column:
        return (x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"])

    def places(s: Column) -> Column:
        before = F.concat(F.array(F.element_at(s, 1)), F.slice(s, 1, F.size(s) - 1))
        after = F.concat(F.slice(s, 2, F.size(s) - 1), F.array(F.element_at(s, -1)))
        near = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
        hit = F.filter(near, lambda z: ((z["b"]["3"] != z["s"]["3"]) & same(z["b"], z["s"])) | ((z["a"]["3"] != z["s"]["3"]) & same(z["a"], z["s"])))
        return F.array_sort(F.transform(hit, lambda z: z["s"]["3"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(F.lit(n), y - x))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(steps, F.lit(n), lambda acc, x: acc + x))

    def sorted_windows(w: Column) -> Column:
        many = F.size(w) - n + 1
        parts = [F.slice(w, k + 1, many) for k in range(n)]
        return F.sort_array(F.transform(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)], F.sequence(F.lit(0), many - 1).alias("at")), lambda z: F.struct(z["w0"].alias("0"), z["w1"].alias("1"), z["w2"].alias("2"), z["at"].alias("3"))))

    counted = bind(words(t), lambda w: F.when(F.size(w) <= n, 0).otherwise(bind(bind(sorted_windows(w), places), covered)))
    return counted.cast("bigint")


@dataclass(frozen=True)
class Measures:
    """What rules read: the text, and counts that may already be columns."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column

    @classmethod
    def of(cls, t: Column) -> Measures:
        return cls(t, n_words(t), word_chars(t), n_symbols(t), n_dup_lines(t))


@dataclass(frozen=True)
class Rule:
    """``rejects`` turns measures into the condition that rejects a text."""

    name: str
    rejects: Callable[[Measures], Column]


def _more(part: Column, percent: int, of: Column) -> Column:
    return 100 * part > percent * of


def _left(t: Column, others: str) -> Column:
    """Characters left without runs of ``others``."""
    return F.char_length(F.regexp_replace(t, others, ""))


RULES = (
    Rule("symbols", lambda m: _more(m.n_symbols, 10, m.n_words)),
    Rule("capitals", lambda m: _more(_left(m.text, r"\P{Lu}+"), 50, _left(m.text, r"\P{L}+"))),
    Rule("exclamations", lambda m: _more(_left(m.text, "[^!]+"), 30, m.n_words)),
    Rule("repeated_lines", lambda m: _more(m.n_dup_lines, 30, F.size(lines(m.text)))),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
    Rule("letterless_words", lambda m: _more(m.n_words - n_of(m.text, r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"), 40, m.n_words)),
    Rule("broken_off_lines", lambda m: bind(lines(m.text), lambda x: _more(F.size(F.filter(x, lambda y: y.rlike("(?:\\.\\.\\.|…)$"))), 30, F.size(x)))),
    Rule("bullets", lambda m: bind(lines(m.text), lambda x: _more(F.size(F.filter(x, lambda y: y.rlike("^[-*•]"))), 90, F.size(x)))),
    Rule("filler", lambda m: F.contains(F.lower(m.text), F.lit("lorem ipsum"))),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of about ``rows`` rows, best rejection per cost first."""
    total = docs.count()
    some = cut_lineage(docs.select(whole_text(text).alias("t")).sample(fraction=min(1.0, rows / max(1, total)), seed=seed))

    def timed(condition: Column) -> tuple[float, float]:
        took, share = [], 0.0
        for _ in range(2):
            began = time.perf_counter()
            share = some.agg(F.avg(condition.cast("int"))).first()[0] or 0.0
            took.append(time.perf_counter() - began)
        return min(took), share

    idle, _ = timed(F.octet_length("t") < 0)
    found = []
    for rule in rules:
        took, share = timed(rule.rejects(Measures.of(F.col("t"))))
        found.append((rule, max(took - idle, 1e-4), float(share)))
    release(some)
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(order: list[Rule], m: Measures) -> Column:
    """Whether no rule rejects the text, asking the rules in turn and stopping at the first that does."""
    chain = None
    for rule in order:
        chain = F.when(rule.rejects(m), False) if chain is None else chain.when(rule.rejects(m), False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` percent of
    them in repeated windows. kept: not base_failed and no rule rejects. A null text has no
    words (base_failed). Equal texts get equal results, an empty table gives an empty one;
    columns named like the outputs end in a ValueError. Rows stay where they are.
    """
    refuse_clash(docs.columns, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    order = [rule for rule, _, _ in estimate(docs, rules, text)]
    t = whole_text(text)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    base = docs.withColumns({"n_words": n_words(t), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(t)})
    base = base.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    return base.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order, Measures(t, *map(F.col, names)))))
