"""Manifest and proofs against trees of lists; order of groups, ties, and proofs that fail."""

import collections
import hashlib

import pytest
from helpers import awkward, documents, empty, real
from pyspark.sql import functions as F

from landledger.llm import manifest
from landledger.llm.ordered import numbered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        first = at // 3 * 3
        yield level[first:at], level[at + 1 : first + 3]
        at //= 3


def plain(rows, claim):
    """rows: (key, group, text)."""
    groups = collections.defaultdict(list)
    for key, group, text in rows:
        groups[group].append((key, leaf((key, group, text)), leaf((key, group, claim(key, text)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (key, own, folded) in enumerate(groups[g]):
            steps = [*way(trees[g], at), *way(top, k)]
            for left, right in steps:
                folded = H(*left, folded, *right)
            out.append((key, own, trees[g][-1][0], top[-1][0], H(*[x for s in steps for side in s for x in side]), folded, folded == top[-1][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("height", [1, 2, manifest.HEIGHT])
def test_proofs_equal_trees_of_lists(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    rows = [(r[0], [None, "a", "é", "Z", "a b"][k % 5 if k % 3 else 1], r[1]) for k, r in enumerate([*real(), *awkward()])]
    rows += [(None, "lone", "x"), *[(7, "ties", "same")] * 11, *[(k, "exact", str(k)) for k in range(27)]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("clash") for c in ("place", "tree", "digest", "claim", "row")})
    tampered = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = manifest.prove(docs, fields=["doc_id", "source", "text"], claims={"text": tampered})
    expected = plain(rows, lambda key, text: text.replace("\n", "") if key is not None and key % 2 == 0 and text else text)
    assert collections.Counter(tuple(r)[:7] for r in got.collect()) == expected
    assert {r[6] for r in expected} == {True, False}


def test_proof_alone_leads_to_the_root(spark):
    docs = documents(spark).withColumns({"source": F.col("lang"), "n_chars": F.length("text")})
    for r in manifest.prove(docs).collect():
        assert r.verified and manifest.fold(r.leaf, r.proof) == r.root == r.folded_root
        assert manifest.fold(H(r.leaf), r.proof) != r.root


def test_empty_table_one_row_and_text_keys(spark):
    nothing = empty(spark).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    assert manifest.prove(nothing).collect() == []
    one = spark.createDataFrame([("k", None, None)], "doc_id string, source string, text string")
    (r,) = manifest.prove(one, fields=["doc_id", "source", "text"]).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == H("1:k", "-", "-") and r.proof_sha256 == H() and r.doc_id == "k"


def test_places_across_partitions(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), "id")
    got = collections.defaultdict(list)
    for r in numbered(rows, "g", [F.col("id")], "places").collect():
        got[r.g].append((r.id, r.place))
    for places in got.values():
        assert [p for _, p in sorted(places)] == list(range(len(places)))
