import collections
import re
import tempfile
import zlib

import numpy as np
import pytest
from helpers import ALNUM, SF, SOLID, awkward, documents, empty, lower, real, words
from test_operators import best_fit_decreasing, jaccard_classes

import corpus_pipeline
from landledger.llm import pii
from landledger.llm.queries import tokenizer_path


def kept_by_quality(text):
    text = text or ""
    w = SOLID.findall(text)
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    return not (len(w) < 50 or 100 * len(hit) > 50 * len(w) or 10 * sum(c in "#*$%&|<>" for c in text) > 2 * len(w)
                or 10 * (len(lines) - len(set(lines))) > 5 * len(lines) or not 2 * len(w) <= sum(map(len, w)) <= 15 * len(w)
                or 10 * text.count("!") > 2 * len(w) or 2 * upper > letters)


def without_passages(text, windows):
    """None for a contaminated text, else the text without hit words and what stands between them."""
    spots = [m.span() for m in ALNUM.finditer(lower(text))]
    w = words(text)
    hit = set()
    for size in {len(p) for p in windows}:
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    if hit and 20 * len(hit) >= len(w):
        return None
    drop = set()
    for k in hit:
        drop |= set(range(spots[k][0], spots[k + 1][0] if k + 1 in hit else spots[k][1]))
    return "".join(c for k, c in enumerate(text) if k not in drop)


def redacted(text):
    out, at = [], 0
    spans = sorted(pii.rule_spans(text), key=lambda s: (s[1], s[2]))
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


@pytest.fixture
def folder(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_pipeline_equals_plain_steps(spark, folder, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda *_: None)  # the rules alone, which have a plain version
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [*real(150), *awkward()]
    body = next(r[1] for r in rows if r[1] and len(words(r[1])) > 700 and kept_by_quality(r[1]))
    rows.append((9100, f"{body}\n{' '.join(words(items[0])[:20])} and more, write to a.b@c.example.org", "en", None, "y", "z"))
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    windows = set()
    for item in items:
        w = words(item)
        size = min(13, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()

    left = [r for r in rows if kept_by_quality(r[1])]
    one_each = {root for _, root, _, _ in jaccard_classes(left)}
    left = list({r[0]: r for r in left if r[0] in one_each}.values())
    clean = [(r[0], without_passages(r[1], windows)) for r in left]
    final = [(key, redacted(text)) for key, text in clean if text is not None]
    assert 10 < len(final) < len(rows)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for key, text in final:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        count = -(-len(ids) // 2048)
        cuts = [0, *range(len(ids) - (count - 1) * 2048, len(ids) + 1, 2048)]
        want.update((key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == best_fit_decreasing([r.length for r in got], 2048)


def test_stages_keep_the_columns(spark, folder):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        assert made.count() > 0, name


def test_empty_documents(spark, folder):
    empty(spark).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_labelled_clean_documents_survive_the_quality_stage(spark):
    path = f"{SF}/../sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    long = [r for r in good.collect() if len(SOLID.findall(r.text)) >= 50]
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, good, path).collect()}
    assert {r.doc_id for r in long} <= kept
