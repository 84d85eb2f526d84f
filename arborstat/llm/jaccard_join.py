"""Exact n-gram Jaccard join of documents by a grouped prefix join.

A document's set holds its distinct word n-grams. Sets are put in one global order, rare
n-grams first, so that two similar sets must share a member of their short prefixes.
Documents with equal sets are one class; classes with the same prefix and size are one
group. Groups that share a prefix member and pass the length and position filters are
candidate group pairs; these are expanded into pairs of classes and verified on texts.

Only components are wanted, so a list of groups that share a prefix member need not be
compared pair by pair: its members meet one pivot first, then the members with most links,
and later only those still in different components are compared. Sets also have 128 parity bits:
pairs that differ in more bits than they may have members apart are dropped inside the joins, so of many copies
that are nearly, but not quite, similar enough few pairs come out. No pair is left out that could join two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.llm.common import gives_back, in_groups, short_batches, whole_text
from arborstat.plans.propagation import connected_components
from arborstat.session import cut_and_count, cut_lineage, release

#: Buckets of the frequency table that sets the order; 4 bytes each, whatever the input.
BUCKETS = 1 << 20
#: Buckets go through the shuffle packed, so many in a row.
PACK = 1 << 12
#: Lists up to this length are compared pair by pair; an entry makes half as many pairs at most.
SHORT_LIST = 16
#: Members of a longer list that meet all others in a round, and rounds.
PIVOTS, ROUNDS = 4, 2
#: Bits of the table that keeps the texts of documents without candidates out of a join; 4 MB, whatever the input.
FILTER_BITS = 1 << 25

_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def gram_set(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams: A-Z lower-cased, words between ASCII white space.

    A text of fewer words has its whole sequence as the only member; one without words has none.
    """
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h * _MIX[k % 3]) + _mixed(words[k : len(words) - size + k + 1] + np.uint64(k))
    return np.unique(_mixed(h))


def need(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection size with which sets of sizes ``a`` and ``b`` link: 100 i >= percent (a + b - i)."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def parities(grams: np.ndarray) -> tuple[int, int]:
    """A bit for each of 128 hash buckets: whether it has an odd number of members. A member that only one of two sets has changes one bit."""
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) & 127, minlength=128) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(">i8").tolist())


def may_link(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether the parities of two sets (columns n, odd0, odd1) differ in no more bits than the sets may have members apart."""
    apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in ("odd0", "odd1")), F.lit(0))
    return apart <= x("n") + y("n") - 2 * need(x("n"), y("n"), percent)


def frequencies(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """In how many documents the n-grams of each bucket occur, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, some = np.zeros(BUCKETS, np.uint32), False
        for b in in_groups(batches, "__text"):
            for t in b.column("__text").to_pylist():
                grams = gram_set(t, n)
                np.add.at(seen, (grams % np.uint64(BUCKETS)).astype(np.int64), 1)
                some = some or len(grams) > 0
        if some:
            packs = seen.reshape(-1, PACK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packs)), pa.int32()), pa.array([p.tobytes() for p in packs], pa.binary())], names=["pack", "seen"])

    def add(key, parts):
        total = sum((np.frombuffer(x, np.uint32).astype(np.int64) for x in parts.column("seen").to_pylist()), np.zeros(PACK, np.int64))
        seen = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"pack": pa.array([key[0].as_py()], pa.int32()), "seen": pa.array([seen], pa.binary())})

    def finish(key, parts):
        total = np.frombuffer(add(key, parts).column("seen")[0].as_py(), np.uint32).astype(np.int64)
        # The order of magnitude is enough: an eighth of a power of two.
        rank = (8 * np.log2(total + 1)).astype(np.uint16)
        return pa.table({"pack": pa.array([key[0].as_py()], pa.int32()), "rank": pa.array([rank.tobytes()], pa.binary())})

    packs = docs.select(whole_text(text).alias("__text")).mapInArrow(gives_back(run), "pack int, seen binary").withColumn("part", F.spark_partition_id() % 512)
    some = packs.groupBy("pack", "part").applyInArrow(add, "pack int, seen binary")  # at most 512 of a pack are left
    with short_batches(docs.sparkSession):
        rows = some.groupBy("pack").applyInArrow(finish, "pack int, rank binary").collect()  # BUCKETS * 2 bytes
    out = np.zeros((BUCKETS // PACK, PACK), np.uint16)
    for r in rows:
        out[r["pack"]] = np.frombuffer(r["rank"], np.uint16)
    return out.reshape(-1)


def row_key(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit digests of what a row has in ``columns``, nulls told apart from other values."""
    null = [F.col(c).isNull() for c in columns]
    return F.xxhash64(F.lit(1), *columns, *null), F.xxhash64(F.lit(2), *null, *columns)


def sketch_sets(docs: DataFrame, rank: np.ndarray, doc_id: str, text: str, n: int, percent: int, key: list[str]) -> DataFrame:
    """(doc_id, a, b, n, odd0, odd1, same, head, prefix): digests of the row's ``key``, set size, parities, digests of the set and of prefix with size, and the prefix in order."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for b in in_groups(batches, "__text"):
            sizes, odd, same, head, prefixes, ends = [], [], [], [], [], [0]
            for t in b.column("__text").to_pylist():
                grams = gram_set(t, n)
                size = len(grams)
                keep = size - (percent * size + 99) // 100 + 1 if size else 0
                order = np.lexsort((grams, rank[(grams % np.uint64(BUCKETS)).astype(np.int64)]))[:keep]
                prefix = grams[order].view(np.int64)
                sizes.append(size)
                odd.append(parities(grams))
                same.append(xxhash.xxh3_128_digest(grams.tobytes()))
                head.append(xxhash.xxh3_128_digest(prefix.tobytes() + size.to_bytes(8, "little")))
                prefixes.append(prefix)
                ends.append(ends[-1] + keep)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("a"), b.column("b"), pa.array(sizes, pa.int64()), *(pa.array([o[k] for o in odd], pa.int64()) for k in (0, 1)), pa.array(same, pa.binary()), pa.array(head, pa.binary()), lists], names=["doc_id", "a", "b", "n", "odd0", "odd1", "same", "head", "prefix"]
            )

    a, b = row_key(key)
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), a.alias("a"), b.alias("b"), whole_text(text).alias("__text"))
    return given.mapInArrow(gives_back(run), "doc_id bigint, a bigint, b bigint, n bigint, odd0 bigint, odd1 bigint, same binary, head binary, prefix array<bigint>")


def _likely(given: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``given`` whose ``key`` is in ``ids``, and some more; a bit table of fixed size keeps most others out of a join."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = (F.bitmap_bucket_number(at) == F.col("__bucket")) & (F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return given.join(F.broadcast(bits), met, "left_semi")  # FILTER_BITS / 8 bytes


def texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of the documents in ``ids``."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), whole_text(text).alias("text")).where("id is not null")
    return _likely(given, ids, "id").join(ids, "id", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(src, dst) of the candidate ``pairs`` (a, b) that link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def grams(i: int, text: str) -> np.ndarray:
            if i not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[i] = gram_set(text, n)
            return kept[i]

        for batch in batches:
            for b in in_groups([batch], "text_a"):
                good = []
                for i, t, u in zip(b.column("a").to_pylist(), b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                    x, y = grams(i, t), gram_set(u, n)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(gives_back(run), "src bigint, dst bigint")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Documents link when 100 * |A and B| >= ``percent`` * |A or B| over sets of word
    ``n``-grams. component_id is the smallest doc_id reachable by links. A row with a null
    or wordless text has size 0 and is its own component; a row without doc_id takes part
    in no link and has a null component; a row that repeats a doc_id gets the component of
    its own text. An empty table gives an empty one; other columns of ``docs`` are not
    looked at. Neither set sizes nor partners are limited.
    """
    sets, roots = linked(docs, doc_id, text, n, percent, [doc_id, text])
    out = sets.join(roots.select("same", F.col("root.doc_id").alias("root")), "same", "left")
    own = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def linked(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, key: list[str], without_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, same) of the sets of all rows (see :func:`sketch_sets`), and (same, root) of every class of rows with equal sets.

    root is the first row of the class's component, as (none, doc_id, a, b): by doc_id,
    null last, then by the digests of its ``key`` columns. Rows without doc_id take part
    if ``without_id``; rows without words are in no class.
    """
    rank = frequencies(docs, text, n)
    with short_batches(docs.sparkSession):
        sets = cut_lineage(sketch_sets(docs, rank, doc_id, text, n, percent, key))
    real = sets.where("n > 0" if without_id else "n > 0 and doc_id is not null")
    # Written once, so that the numbers of the classes stay.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    classes = real.groupBy("same").agg(F.min(row).alias("row"), *[F.min(c).alias(c) for c in ("n", "odd0", "odd1", "head")])
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    groups = cut_lineage(classes.groupBy("head").agg(F.min(F.struct("id", "row.a", "row.b")).alias("first")).select("head", F.col("first.id").alias("gid"), F.col("first.a").alias("ga"), F.col("first.b").alias("gb")))
    member = cut_lineage(classes.join(groups, "head").select("gid", "id", "n", "odd0", "odd1"))

    # A group's rows have one prefix. It is written once before its members are dealt out, and the prefixes of all rows are not kept beside it.
    firsts = cut_lineage(real.join(groups, "head").where("a = ga and b = gb").dropDuplicates(["head", "gid"]).select("gid", "n", "prefix"))
    wide, sets = sets, cut_lineage(sets.select("doc_id", "n", "same"))
    release(wide)
    entry = firsts.select("gid", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = entry.groupBy("gram").agg(F.count("*").alias("size"), F.min("gid").alias("pivot")).where("size > 1")
    lists = cut_lineage(entry.join(shared, "gram"))
    release(firsts)

    a, b = F.col("x.gid"), F.col("y.gid")
    # The first shared member has nothing shared before it, so what follows bounds the intersection.
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (rest >= need(F.col("x.n"), F.col("y.n"), percent))
    x, y = lists.alias("x"), lists.alias("y")
    short = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.size") <= SHORT_LIST) & (F.col("y.size") <= SHORT_LIST) & (a < b) & fits)
    star = x.where(F.col("x.gid") == F.col("x.pivot")).join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("y.size") > SHORT_LIST) & (a < b) & fits)
    met = [j.select(a.alias("g"), b.alias("h")) for j in (short, star)]
    # Inside a group everybody meets the first member.
    inside = member.where("gid <> id").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    pairs = _expand(met[0].unionByName(met[1]).distinct(), member, percent).unionByName(inside).distinct()
    links = _links(docs, pairs, classes, key, text, n, percent)
    found = connected_components(links, links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))), [])

    fits = fits & may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)
    used: DataFrame | None = None
    every, done = False, 0
    while True:
        rows = _open(lists, member, found)
        if every:
            more = _rest(rows, used, fits)
        else:
            chosen = cut_lineage(_pivots(rows, links, used))
            used = chosen if used is None else used.unionByName(chosen)
            more = _meet(rows, chosen, fits)
        more, left = cut_and_count(more, F.lit(True))
        gained = 0
        if left:
            new, gained = cut_and_count(_links(docs, more, classes, key, text, n, percent), F.lit(True))
            if gained:
                links = cut_lineage(links.unionByName(new))
                found = connected_components(links, links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))), [])
        release(rows, more)
        if every:
            break
        # What is in different components after the rounds of pivots is compared in full.
        done += 1
        every = not left or done >= ROUNDS
    release(lists, groups, member)
    of = found.withColumnRenamed("node", "id").join(classes.select("id", "row"), "id")
    least = of.groupBy("component").agg(F.min("row").alias("root"))
    moved = found.withColumnRenamed("node", "id").join(least, "component").select("id", "root")
    return sets, cut_lineage(classes.join(moved, "id", "left").select("same", F.coalesce("root", "row").alias("root")))


def _expand(group_pairs: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of each pair (g, h) of groups whose parities let them link."""
    x, y = group_pairs.join(member.withColumnRenamed("gid", "g"), "g").alias("x"), member.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.gid")) & may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, key: list[str], text: str, n: int, percent: int) -> DataFrame:
    pairs = cut_lineage(pairs)
    some = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = cut_lineage(classes.join(some, "id").select("id", "row.a", "row.b"))
    a, b = row_key(key)
    # One text per class: that of its first row, which may be there more than once.
    given = _likely(docs.select(a.alias("a"), b.alias("b"), whole_text(text).alias("text")), ids, "a")
    texts = cut_lineage(given.dropDuplicates(["a", "b"]).join(ids, ["a", "b"]).select("id", "text"))
    with short_batches(docs.sparkSession):
        links = cut_lineage(verify(pairs, texts, n, percent).distinct())
    release(pairs, ids, texts)
    return links


def _open(lists: DataFrame, member: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, n, odd0, odd1, pos, comp) of the long lists and groups whose members are in more than one component."""
    of = member.join(found.withColumnRenamed("node", "id"), "id", "left").select("gid", "id", "n", "odd0", "odd1", F.coalesce("component", "id").alias("comp"))
    long = lists.where(F.col("size") > SHORT_LIST).select("gram", "gid", "pos")
    inner = of.groupBy("gid").agg(F.countDistinct("comp").alias("k")).where("k > 1").select("gid")
    # A group that did not grow together is a list of its own.
    own = of.join(inner, "gid").select(F.struct(F.lit(None).cast("bigint").alias("gram"), F.col("gid").alias("group")).alias("key"), "id", "n", "odd0", "odd1", F.lit(0).alias("pos"), "comp")
    wide = long.join(of, "gid").select(F.struct("gram", F.lit(None).cast("bigint").alias("group")).alias("key"), "id", "n", "odd0", "odd1", "pos", "comp")
    rows = wide.unionByName(own)
    split = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return cut_lineage(rows.join(split, "key"))


def _pivots(rows: DataFrame, links: DataFrame, used: DataFrame | None) -> DataFrame:
    """(key, id): in each list the PIVOTS members with the most links that were none there yet; a text that many copies come from has links to all pivots before it."""
    degree = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("__links"))
    free = rows if used is None else rows.join(used, ["key", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.coalesce("__links", F.lit(0))), "id"))
    return free.join(degree, "id", "left").select("key", "id", place.alias("place")).where(F.col("place") <= PIVOTS).drop("place")


def _pair(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), on)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _meet(rows: DataFrame, chosen: DataFrame, fits: Column) -> DataFrame:
    """Pairs (a, b) of the chosen members with those of their list that are in other components."""
    return _pair(rows.join(chosen, ["key", "id"], "left_semi"), rows, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & fits)


def _rest(rows: DataFrame, used: DataFrame, fits: Column) -> DataFrame:
    """All pairs (a, b) that share a list, are in different components and have not met."""
    new = rows.join(used, ["key", "id"], "left_anti")
    return _pair(new, new, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & fits)
