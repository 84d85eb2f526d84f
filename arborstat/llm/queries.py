"""Queries over whole tables, one per operator, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborstat.llm import bpe, hard_negatives, jaccard_join, language_crf, merkle, mixing, quality_mil, quality_rules, secrets, token_counts, topk_search, toxicity_kn, url_filter
from arborstat.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_bpe_trie")
def bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    both = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"], decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, long ones by overlapping chunks."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


@query("op10_jaccard_join")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard similarity 0.9 or more."""
    return jaccard_join.components(table(spark, sf_dir, "documents"), n=3, percent=90)


#: Spans of the three base kinds and more, over whole texts; the engine of the SQL finds no places, so there is none.
@query("op3_secrets")
def find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    counts = [F.size(secrets.of_kind("spans", k)).cast("bigint").alias(f"n_{k}") for k in base]
    digest = F.sha2(secrets.written(secrets.of_kind("spans", *base)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.written("spans").alias("spans"))


@query("op8_language_crf")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    docs = table(spark, sf_dir, "documents")
    model = language_crf.train(docs, ~held_out())
    found = language_crf.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


MIX_SQL = r"""
with recursive d as (
  select doc_id, coalesce('=' || source, '') s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint tokens,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':1'), 1, 15))::bigint place, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':1:in'), 1, 15))::bigint inner_place, source
  from documents),
t as (select s, sum(tokens)::bigint tokens from d group by s),
p as (select s, tokens, tokens::double / (select sum(tokens) from t)::double share from t where tokens > 0),
b(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1, case when r <= 1.25 then lo else mid end, case when r <= 1.25 then mid else hi end
  from (select i, lo, hi, (lo + hi) / 2 mid, (select max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) from p) r from b where i < 32)),
x as (select case when (select max(1 / share) / count(*) from p) <= 1.25 then 0.0 else (select hi from b where i = 32) end alpha),
w as (select s, tokens, pow(share, alpha) / (select sum(pow(share, alpha)) from p, x) * (select sum(tokens) from p)::double / tokens times from p, x
  union all select s, tokens, 1.0 from t where tokens = 0),
plan as (select s, times, floor(times + 1e-9)::bigint epochs, greatest(0.0, times - floor(times + 1e-9)) * tokens rest, greatest(1, ceil(tokens / 65536.0))::bigint blocks from w),
e as (select d.*, times, epochs, rest, blocks, place % blocks block from d join plan using (s)),
g as (select s, block, sum(tokens) tokens, any_value(epochs) epochs, any_value(rest) rest,
    ('0x' || substr(md5(s || ':' || block || ':' || any_value(epochs) || ':1'), 1, 15))::bigint turn from e group by s, block),
u as (select *, sum(tokens) over (partition by s order by turn, block rows unbounded preceding) upto from g),
k as (select e.*, upto <= u.rest whole, u.rest - upto + u.tokens room, sum(e.tokens) over (partition by e.s, e.block order by inner_place) so_far from e join u on e.s = u.s and e.block = u.block),
c as (select *, epochs + case when whole or (room > 0 and so_far <= room) then 1 else 0 end copies from k),
z as (select doc_id, source, s, tokens, block, times, unnest(range(copies)) epoch from c where copies > 0)
select doc_id, source, tokens n_tokens, epoch::int epoch,
  round((epoch + ('0x' || substr(md5(s || ':' || block || ':' || epoch || ':1'), 1, 15))::bigint / 1152921504606846976.0::double) / times, 9) mix_order
from z
"""


@query("op1_temperature_mix", MIX_SQL)
def temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, sources as even as a repetition limit of 1.25 allows; a row per copy taken, in the order of the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", mixing.words().alias("n_tokens"))
    mixed = mixing.in_order(mixing.mix(docs, max_repeats=1.25).select("doc_id", "source", "n_tokens", "epoch", "mix_order"))
    return mixed.withColumn("mix_order", F.round("mix_order", 9))


RULES_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
g as (select doc_id, i, w[i] a, w[i + 1] b, w[i + 2] c from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) n from g) where n > 1),
c as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from r) group by doc_id),
m as (
  select doc_id, t, l, w, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
  from d left join c using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed
    or 100 * n_symbols > 10 * n_words
    or 100 * len(regexp_extract_all(t, '\p{Lu}')) > 50 * len(regexp_extract_all(t, '\p{L}'))
    or 100 * len(regexp_extract_all(t, '!')) > 30 * n_words
    or 100 * n_dup_lines > 30 * len(l)
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 100 * len(list_filter(w, lambda x: not regexp_matches(x, '\p{L}'))) > 40 * n_words
    or 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) > 30 * len(l)
    or 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[-*•]'))) > 90 * len(l)
    or contains(lower(t), 'lorem ipsum')) kept
from f
"""


@query("op5_quality_rules", RULES_SQL)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the rule cascade."""
    found = quality_rules.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_toxicity_kn")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by class-conditional word models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity_kn.score(docs, table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


TOPK_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
  from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op6_topk_search", TOPK_SQL)
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op7_quality_mil")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality_mil.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Distinct texts whose checksum is read bit by bit: the SQL has no function for it.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::bigint], {bytes}), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ASCII_BYTES = "list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)"
ANY_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda c: ('0x' || c)::bigint)"


def _url_sql(order: int = url_filter.ORDER) -> str:
    """The models level by level, as in the operator."""
    names = ["a", "b", "ap", "bp"]
    fits = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, path = rule.split("/", 1)
        fits.append(((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"), rule, verdict))
    name, ruled = ("case " + " ".join(f"when {c} then '{x[i]}'" for c, *x in fits) + " end" for i in (0, 1))
    levels = [f"g{order} as (select gram, " + ", ".join(f"count(*) filter (where verdict = '{v}'{'' if n == v[0] else ' and not kept_back'}) {n}" for v in ("allow", "block") for n in (v[0], v[0] + "p")) + " from w group by gram)"]
    for k in range(order - 1, -1, -1):
        levels.append(f"g{k} as (select substr(gram, 2) gram, " + ", ".join(f"sum({n})::bigint {n}" for n in names) + f" from g{k + 1} group by 1)")
    for k in range(order + 1):
        own = ", ".join(f"sum({n}) over c n_{n}, count(*) filter (where {n} > 0) over c t_{n}" for n in names)
        short = "1.0::double / letters" if not k else "s.p_{0}"
        mix = ", ".join(f"case when n_{n} = 0 then {short.format(n)} else ({n} + t_{n} * ({short.format(n)})) / (n_{n} + t_{n})::double end p_{n}" for n in names)
        seen = f"select *, {own}, count(*) over c letters from g{k} window c as (partition by substr(gram, 1, {k}))"
        levels.append(f"p{k} as (select x.gram, {mix} from ({seen}) x" + (f" join p{k - 1} s on s.gram = substr(x.gram, 2))" if k else ")"))
    unit, steps = url_filter.UNIT, url_filter.STEPS
    crc = CRC_SQL.format(bytes=ANY_BYTES.format("url"))
    return rf"""
with r as (select page_id, coalesce(url, '') url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r),
j as (select *, {name} rule, {ruled} ruled from h),
u as (select url, any_value(ruled) verdict, any_value(ruled) is not null and {crc} % {url_filter.KEPT_BACK} = 0 kept_back from j group by url),
z as (select *, repeat(chr(2), {order}) || url || chr(3) padded from u),
w as (select url, verdict, kept_back, substr(padded, i, {order + 1}) gram from (select *, unnest(range(1, length(padded) - {order} + 1)) i from z)),
{", ".join(levels)},
l as (select gram, round((ln(p_a) - ln(p_b)) * {unit})::bigint ratio, round((ln(p_ap) - ln(p_bp)) * {unit})::bigint part from p{order}),
s as (select url, any_value(verdict) verdict, floor(sum(case when kept_back then part else ratio end)::double / (count(*) * {unit // steps}))::bigint score
  from w join l using (gram) where verdict is null or kept_back group by url),
b as (select score, count(*) filter (where verdict = 'allow') a, count(*) filter (where verdict = 'block') b from s where verdict is not null group by score),
c as (select score, sum(a) over () ta, sum(b) over () tb, coalesce(sum(a) over (order by score rows between unbounded preceding and 1 preceding), 0) ba,
    coalesce(sum(b) over (order by score rows between unbounded preceding and 1 preceding), 0) bb from b),
m as (select coalesce((select score from c where ta > 0 and tb > 0 order by ba * tb + (tb - bb) * ta, abs(score), score limit 1), 0) lim)
select page_id, host, path, rule, coalesce(ruled, case when score >= lim then 'allow' else 'block' end) verdict from j left join s using (url) cross join m
"""


@query("op11_url_filter", _url_sql())
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


HARD_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id anchor_id, c.vec_id, a.label = c.label same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::bigint score
  from e a join e c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) place from s where same) where place <= 5),
n as (
  select p.anchor_id, p.vec_id positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int rank, s.vec_id negative_id, p.score positive_score, s.score negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select * from n where rank <= 5
"""


@query("op12_hard_negatives", HARD_SQL)
def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def _merkle_sql(levels: int = 6, fanout: int = 16) -> str:
    """The tree level by level; ``levels`` of ``fanout`` are more than the tables of the check need."""

    def tree(name: str, leaves: str) -> str:
        """Levels of (tree, n, pos, digest): ``n`` nodes of the level in the tree, each joined from the one below."""
        steps = [f"{name}0 as ({leaves})"]
        for i in range(1, levels + 1):
            steps.append(f"{name}{i} as (select tree, (any_value(n) + {fanout - 1}) // {fanout} n, pos // {fanout} pos, sha256(string_agg(digest, '' order by pos)) digest from {name}{i - 1} where n > 1 group by tree, pos // {fanout})")
        return ", ".join(steps)

    def paths(name: str) -> str:
        """Of every node the joined siblings before and after (b, a) by level: (tree, level, pos, b, a)."""
        runs = "partition by tree, pos // %d order by pos rows between" % fanout
        each = [
            f"select tree, {i} level, pos, coalesce(string_agg(digest, '') over ({runs} unbounded preceding and 1 preceding), '') b, coalesce(string_agg(digest, '') over ({runs} 1 following and unbounded following), '') a from {name}{i} where n > 1"
            for i in range(levels + 1)
        ]
        return " union all ".join(each)

    def ends(name: str) -> str:
        return " union all ".join(f"select tree, digest from {name}{i} where n = 1" for i in range(levels + 1))

    def fold(name: str, start: str, siblings: str, key: str) -> str:
        steps = [f"{name}0 as ({start})"]
        for i in range(levels):
            steps.append(
                f"{name}{i + 1} as (select f.* exclude (h, proof), case when s.pos is null then h else sha256(s.b || h || s.a) end h, proof || coalesce(s.b || s.a, '') proof "
                f"from {name}{i} f left join {siblings} s on s.tree = f.{key}tree and s.level = {i} and s.pos = f.{key}pos // {fanout ** i})"
            )
        return ", ".join(steps)

    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = CRC_SQL.format(bytes=ASCII_BYTES.format("doc_id::varchar"))
    return f"""
with d as (
  select doc_id, source, {leaf("text")} leaf, case when {crc} % 5 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end changed from documents),
o as (
  select *, dense_rank() over (order by source nulls first) - 1 tree, count(*) over (partition by source) n,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos from d),
{tree("l", "select tree, n, pos, leaf digest from o")}, ends as ({ends("l")}), ls as materialized ({paths("l")}),
{tree("h", "select 0 tree, count(*) over () n, tree pos, digest from ends")}, roots as ({ends("h")}), hs as materialized ({paths("h")}),
{fold("u", "select doc_id, leaf, tree ltree, pos lpos, 0 htree, tree hpos, coalesce(changed, leaf) h, '' proof from o", "ls", "l")},
{fold("v", f"select * from u{levels}", "hs", "h")}
select doc_id, leaf, ends.digest subroot, roots.digest root, sha256(proof) proof_sha256, h folded_root, h = roots.digest verified
from v{levels} join ends on ends.tree = ltree cross join roots
"""


@query("op13_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; rows marked by their id are tampered with and checked against their proofs."""
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": F.when(marked, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    checked = merkle.verify(found.leaves)
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
