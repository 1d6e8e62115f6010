"""Exact dedup against grouping in a dictionary."""

import collections
import hashlib
import re

import pytest
from helpers import awkward, documents, empty, real

from landledger.llm import copies


def plain(rows):
    """(key, keep, size, sha) per row and how many rows stay, keys with null last."""
    groups = collections.defaultdict(list)
    for key, text, *_ in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(key)
    out = []
    for sha, keys in groups.items():
        least = min(keys, key=lambda k: (k is None, k or 0))
        out += [(k, least, len(keys), sha) for k in keys]
    return out, len(groups)


@pytest.mark.parametrize("broadcast_words", [copies.BROADCAST_WORDS, 0])
def test_marks_equal_a_dictionary(spark, broadcast_words):
    rows = [*real(), *awkward(), *[(k, f"copy\t of \n{k % 7 and 'many'}", "en", "a", "b", "c") for k in range(20_000, 20_400)]]
    got = copies.mark(documents(spark, rows), broadcast_words=broadcast_words).collect()
    expected, groups = plain(rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter(expected)
    assert sum(r.kept for r in got) == groups
    for r in got:
        assert r.doc_id == r.keep_id if r.kept else r.group_size > 1


def test_kept_rows_have_all_columns(spark):
    rows = [*real(), *awkward()]
    docs = documents(spark, rows).withColumnsRenamed({"n_words": "digest", "near_row": "keeper", "held": "row"})
    kept = copies.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == plain(rows)[1]
    assert {r.doc_id for r in kept.collect()} == {k for _, k, _, _ in plain(rows)[0]}


def test_empty_table_and_all_equal(spark):
    assert copies.mark(empty(spark)).collect() == []
    assert copies.keep(empty(spark)).collect() == []
    got = copies.mark(documents(spark, [(k, None if k % 2 else "", None, None, None, None) for k in range(50)])).collect()
    assert {(r.keep_id, r.group_size, r.kept) for r in got} == {(0, 50, True), (0, 50, False)}


def test_no_repeated_key_is_missed_by_the_filters(spark):
    rows = spark.range(3_000).selectExpr("unhex(sha2(cast(id % 2500 AS STRING), 256)) AS digest")
    repeated = spark.range(500).selectExpr("unhex(sha2(cast(id AS STRING), 256)) AS digest")
    for words in (1, 64, 1024):
        found = copies._keys(repeated, words).join(copies.second_filter(rows, words), "word")
        assert found.where("again & mask = mask").count() == 500
    # and few others pass
    others = spark.range(500, 2_500).selectExpr("unhex(sha2(cast(id AS STRING), 256)) AS digest")
    assert copies._keys(others, 1024).join(copies.second_filter(rows, 1024), "word").where("again & mask = mask").count() < 60
