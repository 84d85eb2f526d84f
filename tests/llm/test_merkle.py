"""The manifest against a tree built by plain recursion."""

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from arborstat.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(tree, at, fanout):
    steps = []
    for nodes in tree[:-1]:
        first = at // fanout * fanout
        run = nodes[first : first + fanout]
        steps.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= fanout
    return steps


def expected(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], H(*map(field, (r[0], r[2], r[1], r[3], r[4]))), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]], fanout)
    top = levels([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for at, (doc, leaf, r) in enumerate(by[s]):
            steps = proof(trees[s], at, fanout) + proof(top, k, fanout)
            text, folded = r[4], leaf
            if doc is not None and crc32(str(doc).encode()) % 5 == 0 and text is not None:
                folded = H(*map(field, (r[0], r[2], r[1], r[3], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))
            for before, after in steps:
                folded = H(before, folded, after)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], H("".join(b + a for b, a in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(docs, fanout=merkle.FANOUT):
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(docs, fanout=fanout, tampered={"text": F.when(marked, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    rows = merkle.verify(made.leaves).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=str), made


@pytest.mark.parametrize("fanout", [3, 16])
def test_against_recursion(spark, fanout):
    rows = [(i, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 40 if i % 2 else 0}", i if i % 5 else None, [f"Some Text {i}", "", None, "äÖ ABC"][i % 4]) for i in range(300)]
    rows += [(7, "en", "s1", 3, "again"), (7, "en", "s1", 3, "again"), (None, None, None, None, None), (None, "x", "s0", 1, "No Id"), (900, "en", "alone", 1, "A"), (901, "en", "Zoë", 1, "B"), (902, "en", "", 1, "C")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    got, made = found(docs.withColumns({c: F.lit("x") for c in ("tree", "at", "n", "leaf", "path", "digest", "root", "place", "up")}).repartition(5), fanout)
    assert got == expected(rows, fanout)
    assert made.roots.agg(F.sum("n_leaves")).first()[0] == len(rows)


def test_sizes_at_the_edges_of_runs(spark):
    for n in (1, 16, 257):
        rows = [(i, "en", "only", 1, f"T{i}") for i in range(n)]
        got, _ = found(spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string"))
        assert got == expected(rows, 16)


def test_empty(spark, no_docs):
    assert found(no_docs)[0] == []
