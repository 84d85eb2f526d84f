"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: an
"or" of branches, each an "and" of trigrams that every match of that branch contains.
The trigrams that some rule asks for are indexed (postings: trigram, document); postings
are intersected per branch, and only the documents left over are matched against the
rule. A rule with a branch that has no certain trigram reads every document.

Everything runs on built-in expressions; Python only derives the queries.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.llm.common import bind, refuse_clash, whole_text
from arborstat.session import cut_lineage, release

#: Alternatives of one rule that are told apart; beyond that the rule reads every document.
MAX_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points that ``group`` needs; other matches are dropped
    group: int = 0


_PEM_END = r"-----END [A-Z ]*PRIVATE KEY-----"
#: Line ends, also as written in strings of code.
_BREAK = r"(?:\s|\\[nrt])++"
#: What follows the head of a key: all up to its end mark, else its base64 lines and the shorter line after them.
_PEM_BODY = (
    rf"(?:[^-]*+(?:-(?!----)[^-]*+)*+{_PEM_END}"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+=*+)++(?:{_BREAK}[A-Za-z0-9+/]++=*+(?=[\x20\t]*+(?:[\r\n\\\"']|$)))?+)?+"
)

#: Base kinds first, in the order in which spans at one place are listed (fixed values).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _PEM_BODY),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]+://[^/\s:@]+:[^/\s:@]+@"),
)
RULES = BASE + MORE


# A branch under way: (trigrams found for certain, text that surely precedes what follows, or None after a gap).
def _branches(items, done: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
    """Every way through ``items`` in lower case: certain trigrams and the certain text at the end."""
    for op, arg in items:
        if op is regex_tree.LITERAL:
            done = [_grow(b, chr(arg).lower()) for b in done]
        elif op is regex_tree.IN and (chars := _few(arg)):
            done = [_grow(b, c) for b in done for c in chars]
        elif op is regex_tree.SUBPATTERN:
            done = _branches(arg[-1], done)
        elif op is regex_tree.BRANCH:
            done = [x for way in arg[1] for x in _branches(way, done)]
        elif op is regex_tree.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is regex_tree.LITERAL:
            done = [*done, *_branches(arg[2], done)]
        else:
            done = [(grams, "") for grams, _ in done]  # anything may stand here
        done = list(dict.fromkeys(done))
        if len(done) > MAX_BRANCHES:
            done = [(frozenset.intersection(*(g for g, _ in done)), "")]
    return done


def _few(chars) -> list[str]:
    """The characters of a class of up to eight single ones, else none."""
    one = [chr(a).lower() for op, a in chars if op is regex_tree.LITERAL]
    return sorted(set(one)) if len(one) == len(chars) <= 8 else []


def _grow(branch: tuple[frozenset[str], str], c: str) -> tuple[frozenset[str], str]:
    grams, tail = branch
    tail += c
    return (grams | {tail[-3:]} if len(tail) >= 3 else grams), tail[-2:]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Branches of trigrams (lower case), one of which every text with a match contains whole; None if nothing is certain."""
    found = {grams for grams, _ in _branches(regex_tree.parse(pattern), [(frozenset(), "")])}
    if frozenset() in found:
        return None
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(doc, trigram): the inverted index of the trigrams that the rules ask for; doc is a digest of the text."""
    wanted = sorted({g for r in rules for branch in trigram_query(r.pattern) or () for g in branch})
    low = docs.select(F.xxhash64(whole_text(text), F.lit(1)).alias("a"), F.xxhash64(whole_text(text), F.lit(2)).alias("b"), F.lower(whole_text(text)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted]))
    return low.select(F.struct("a", "b").alias("doc"), F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, kinds): rules that may match in each text, by intersecting postings."""
    spark = index.sparkSession
    asked = [(r.kind, n, g, len(branch)) for r in rules for n, branch in enumerate(trigram_query(r.pattern) or ()) for g in sorted(branch)]
    terms = spark.createDataFrame(asked, "kind string, branch int, trigram string, size int")
    met = index.distinct().join(F.broadcast(terms), "trigram")  # terms: a few per rule, whatever the input
    whole = met.groupBy("doc", "kind", "branch").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size")
    return whole.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))  # one entry per rule at most


def _spans(rule: Rule, text: Column) -> Column:
    """Leftmost non-overlapping matches as structs (start, stop, kind): code points, stop exclusive.

    The pieces between matches and the matches themselves give the places.
    """
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    order = F.lit(next((i for i, r in enumerate(RULES) if r.kind == rule.kind), len(RULES)))
    steps = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(matches, F.char_length).alias("size"), F.transform(sized, F.char_length).alias("judged"))
    none = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), order.alias("order"), (begin + x["size"]).alias("stop"), F.lit(rule.kind).alias("kind"))
        good = x["size"].isNotNull() & (x["judged"] >= rule.least)
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: array of (start, order, stop, kind), by start and then as the rules are listed.

    start and stop count code points. A null text counts as empty. Rows with equal texts
    get equal spans; rows stay as they are otherwise, other columns included (one named ``spans``
    ends in a ValueError). An empty table gives an empty one.
    """
    refuse_clash(docs.columns, [spans])
    index = cut_lineage(postings(docs, rules, text))
    found = cut_lineage(candidates(index, rules).select(F.col("doc.a").alias("__a"), F.col("doc.b").alias("__b"), F.col("kinds").alias("__kinds")))
    release(index)
    keyed = docs.withColumns({"__a": F.xxhash64(whole_text(text), F.lit(1)), "__b": F.xxhash64(whole_text(text), F.lit(2))})
    joined = keyed.join(found, ["__a", "__b"], "left")
    t = whole_text(text)
    none = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")
    parts = []
    for r in rules:
        may = t.rlike(r.pattern) if trigram_query(r.pattern) is None else F.array_contains("__kinds", r.kind)
        parts.append(F.when(may, _spans(r, t)).otherwise(none))
    return joined.withColumn(spans, F.sort_array(F.flatten(F.array(*parts)))).drop("__a", "__b", "__kinds")


def written(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def of_kind(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    t = whole_text(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        # Inside what is already replaced: only move the end. The mark goes in front of what follows.
        new = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        apart = (s["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, new).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.char_length(t))))
    )
