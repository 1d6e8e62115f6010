import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, SOLID, awkward, documents, empty, fold, lower, real, words
from pyspark.sql import functions as F

from landledger.llm import decontaminate, html, language, licenses, near, packing, pii, quality, scoring, token_store
from landledger.llm.components import components
from landledger.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


# -- 1 packing --------------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_packs_like_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, 1 + capacity // 8) for _ in range(300)] + [capacity // 2] * rng.randint(0, 80)
    counts = collections.Counter(lengths)
    runs = packing.sweep(counts, capacity)
    used = collections.defaultdict(list)
    for n, many in counts.items():
        mine = [k for k in range(len(runs["rank"])) if runs["length"][k] == n]
        for rank in range(many):
            k = max((k for k in mine if runs["rank"][k] <= rank), key=lambda k: runs["rank"][k])
            used[runs["sequence"][k] + rank - runs["rank"][k]].append((runs["offset"][k], n))
    assert len(used) == best_fit_decreasing(lengths, capacity)
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_pieces_and_places(spark, ids):
    capacity = 256
    got = packing.pack(documents(spark), tokenizer_path(), capacity=capacity).collect()
    want = collections.Counter()
    for doc_id, text, *_ in [*real(), *awkward()]:
        own = ids(text)
        count = -(-len(own) // capacity)
        head = len(own) - (count - 1) * capacity
        cuts = [0, *range(head, len(own) + 1, capacity)]
        want.update((doc_id, k, a, b - a, crc(own[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(sequences) == best_fit_decreasing([r.length for r in got], capacity)


def test_packing_nothing(spark):
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


# -- 2 licenses -------------------------------------------------------------------------


def test_licenses(spark):
    step = max(len(b.split()) for _, b in licenses.TEMPLATES)
    got = collections.Counter(tuple(r) for r in licenses.scan(documents(spark)).collect())
    want = collections.Counter()
    for doc_id, text, *_ in [*real(), *awkward()]:
        w = words(text)
        found, labels, score = [], set(), 0.0
        for label, body in licenses.PHRASES:
            p = body.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            found += hits
            labels |= {label} if hits else set()
        base = ",".join(sorted(labels))
        for a in range(-step, len(w), step):
            block = set(w[max(a, 0) : a + 2 * step])
            for label, body in licenses.TEMPLATES:
                share = len(block & set(body.split())) / len(set(body.split()))
                if share >= licenses.CONTAINMENT - 1e-9:
                    labels.add(label)
                    score = max(score, share)
        want[(doc_id, len(w), len(found), min(found, default=None), max(found, default=None), base, ",".join(sorted(labels)), score)] += 1
    assert got == want
    assert licenses.scan(empty(spark)).count() == 0


def test_license_plan_is_native(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# -- 3 personal data --------------------------------------------------------------------


def test_rules_equal_plain_expressions():
    import re

    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(d[::-1][::2] + [sum(divmod(2 * x, 10)) for x in d[::-1][1::2]]) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return out

    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@-+_ ()%5 .2@x") for _ in range(rng.randint(0, 60)))
        assert plain(t) == pii.rule_spans(t)
    for _, t, *_ in [*real(), *awkward()]:
        assert plain(t or "") == pii.rule_spans(t or "")
    assert pii.rule_spans("1" * 50_000 + "a" * 50_000) == []


def test_gradients():
    tagger = pii.Tagger()
    rng = np.random.default_rng(0)
    codes = rng.integers(0, pii.N_CHARS, (3, 7))
    labels = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0]])
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, d = tagger.gradients(codes, labels)
    for k, v in tagger.p.items():
        at = np.unravel_index(np.argmax(np.abs(d[k])), v.shape)
        losses = []
        for step in (1e-4, -2e-4):
            v[at] += step
            losses.append(tagger.gradients(codes, labels)[0])
        v[at] += 1e-4
        assert abs((losses[0] - losses[1]) / 2e-4 - d[k][at]) < 1e-3 * max(1, abs(d[k][at])), k


def test_viterbi_equals_all_sequences():
    import itertools

    tagger = pii.Tagger(7)
    codes = np.random.default_rng(1).integers(0, pii.N_CHARS, (2, 4))
    scores, _ = tagger.emissions(codes)
    jump = tagger._jump()
    for row, got in enumerate(tagger.decode(codes)):
        def total(path, row=row):
            return sum(scores[t, row, x] for t, x in enumerate(path)) + sum(jump[a, b] for a, b in zip(path, path[1:], strict=False))

        assert tuple(got) == max(itertools.product(range(pii.N_LABELS), repeat=4), key=total)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"))


def test_tagger_finds_held_out_shapes(spark, tagger):
    seen = {r[0] for r in spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").select("text").collect()}
    rows = [r[0] for r in spark.read.parquet(f"{SF}/../sf0.1/documents.parquet").where(F.col("text").rlike("[0-9@]")).select("text").limit(300).collect()]
    texts = [t for t in rows if t not in seen]
    want = {(k, *s[:3]) for k, t in enumerate(texts) for s in pii.shapes(t)}
    got = {(k, *s) for k, spans in enumerate(pii.network_spans(texts, tagger)) for s in spans}
    assert len(want) > 100
    assert len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.1 * len(got)


def test_personal_data(spark, tagger):
    got = {}
    for r in pii.report(documents(spark), tagger).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text, *_ in [*real(), *awkward()]:
        spans = pii.rule_spans(text or "")
        r = got[doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.report(empty(spark)).count() == 0


def test_redaction(spark, tagger):
    docs = documents(spark)
    done = pii.redact(docs, tagger)
    assert done.columns == docs.columns and done.count() == docs.count()
    text = done.where("doc_id = 9009").first().text
    assert "@" not in text and "4111" not in text and "0199" not in text and "10.0.0.25," not in text
    assert done.where("doc_id = 9001").first().text is None


def test_long_runs_of_digits(spark):
    run = "0" * 5000
    rows = [(1, run + "1.1.1.1", None, "", "", ""), (2, f"1.1.1.{run}255 and 1.1.{run}256.1", None, "", "", ""), (3, "9" * 6000 + ".1.2.3 +" + run, None, "", "", "")]
    spans = [pii.rule_spans(text) for _, text, *_ in rows]
    assert spans == [[("ip", 0, 5007)], [("ip", 0, 5009)], []]
    report = {r.doc_id: (r.n_ip, r.n_card, r.n_phone) for r in pii.report(documents(spark, [*real(), *rows])).collect()}
    assert [report[k] for k in (1, 2, 3)] == [(1, 0, 0), (1, 0, 0), (0, 0, 0)]


# -- 4 quality --------------------------------------------------------------------------


def test_quality(spark):
    docs = documents(spark)
    got = collections.Counter(tuple(r) for r in quality.report(docs).drop("rejected_by", "kept").collect())
    want = collections.Counter()
    for doc_id, text, *_ in [*real(), *awkward()]:
        text = text or ""
        w = SOLID.findall(text)
        lines = [x for x in text.split("\n") if SOLID.search(x)]
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want[(doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in quality.report(docs).where("kept").collect())
    assert quality.report(empty(spark)).count() == quality.keep(empty(spark)).count() == 0


@pytest.mark.parametrize("order", [list(quality.RULES), list(quality.RULES)[::-1]])
def test_cascade_order_does_not_change_the_verdict(order):
    column = pa.array([r[1] for r in [*real(200), *awkward()]], pa.string())
    alone = np.logical_or.reduce([rule(quality.Texts(column)) for rule in quality.RULES.values()])
    assert ((quality.cascade(column, quality.RULES, order) >= 0) == alone).all()


def test_quality_agrees_with_labels(spark):
    path = f"{SF}/../sf0.01"
    judged = quality.report(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    rows = judged.where("n_words >= 50").select("quality", "kept").collect()
    assert all(r.kept == bool(r.quality) for r in rows)


# -- 5 language -------------------------------------------------------------------------


def test_phrases_equal_plain_parsing():
    rng = random.Random(2)
    samples = {x: np.array([ord(rng.choice(letters)) for _ in range(400)], np.uint32) for x, letters in (("one", "abc"), ("two", "abd"))}
    parser = language.Parser(samples)
    rows = [[ord(rng.choice("abcdx")) for _ in range(rng.choice([0, 1, 30, language.PIECE + 40]))] for _ in range(20)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = parser.phrases(np.array(sum(rows, []), np.uint32), bounds)
    for k, name in enumerate(parser.languages):
        known = "".join(map(chr, samples[name]))
        for row, text in enumerate(rows):
            total = 0
            for at in range(0, len(text), language.PIECE):
                piece, a = "".join(map(chr, text[at : at + language.PIECE])), 0
                while a < len(piece):
                    b = a + 1
                    while b < len(piece) and piece[a : b + 1] in known and piece[a:b] in known:
                        b += 1
                    total, a = total + 1, b
            assert got[k, row] == total, (name, text)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    parser = language.learn(docs.where(~held))
    rows = language.predict(docs.where(held), parser).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    got = {r.doc_id: r for r in language.predict(documents(spark), parser).collect()}
    assert {got[k].lang_pred for k in (9001, 9002, 9003, 9007)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(empty(spark), parser).count() == 0
    assert {r.lang_pred for r in language.predict(documents(spark), language.learn(empty(spark))).collect()} == {"und"}


# -- 6 scoring --------------------------------------------------------------------------


def test_scores(spark):
    rows = [*real(), *awkward()]
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in scoring.score(documents(spark), held).collect())
    tokens = [[*SOLID.findall(lower(r[1] or "")), "\n"] for r in rows]
    training = [t for r, t in zip(rows, tokens, strict=True) if not fold(r[0], 5, 1)]
    counts = collections.Counter(x for t in training for x in t)
    total, distinct = sum(counts.values()), len(counts)

    def stream(t):
        return (" ".join(t[:-1]) + "\n").encode()

    grams = collections.Counter()
    for t in training:
        s = [0] * (scoring.ORDER - 1) + [int(scoring.CLASS[b]) for b in stream(t)]
        grams.update(tuple(s[k : k + scoring.ORDER]) for k in range(len(s) - scoring.ORDER + 1))
    seen, whole, kinds = collections.Counter(), collections.Counter(), collections.Counter()
    for g, n in grams.items():
        for m in range(1, scoring.ORDER + 1):
            seen[g[-m:]] += n
    for g, n in seen.items():
        whole[g[:-1]] += n
        kinds[g[:-1]] += 1

    def probability(h, x):
        if not h:
            return (seen[(x,)] + 0.5) / (sum(grams.values()) + 0.5 * scoring.CLASSES)
        if not whole[h]:
            return probability(h[1:], x)
        return max(0, seen[(*h, x)] - scoring.DISCOUNT) / whole[h] + scoring.DISCOUNT * kinds[h] / whole[h] * probability(h[1:], x)

    want = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t)
        s = [0] * (scoring.ORDER - 1) + [int(scoring.CLASS[b]) for b in stream(t)]
        memo = {}
        model = sum(scoring.WITHIN[x] for x in s[scoring.ORDER - 1 :])
        for k in range(scoring.ORDER - 1, len(s)):
            key = tuple(s[k - scoring.ORDER + 1 : k + 1])
            if key not in memo:
                memo[key] = math.log10(probability(key[:-1], key[-1]))
            model += memo[key]
        want[(r[0], fold(r[0], 5, 1), len(t), sum(counts[x] > 0 for x in t), total, round(base, 6), round(model, 4))] += 1
    assert got == want


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    grams, counts = np.unique(rng.integers(0, 64**4, 500), return_counts=True)
    machine = scoring.BackoffAutomaton(grams, counts)
    assert np.allclose((10 ** machine.weight.reshape(-1, scoring.CLASSES)).sum(axis=1), 1)


def test_scoring_nothing(spark):
    assert scoring.score(empty(spark), F.lit(False)).count() == 0
    assert scoring.score(documents(spark, real(2)), F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


# -- 7 token store ----------------------------------------------------------------------


def test_store_round_trip(spark, ids):
    docs = documents(spark)
    store = token_store.write_store(docs, tokenizer_path())
    got = token_store.read_store(store, docs.select("doc_id")).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((r[0], len(ids(r[1])), crc(ids(r[1]))) for r in [*real(), *awkward()])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    some = spark.createDataFrame([(9004,), (3,), (123456,)], "doc_id long")
    assert sorted(r.doc_id for r in token_store.read_store(store, some).collect()) == [3, 9004, 9004]


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    levels, slots = token_store.minimal_perfect_hash(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (token_store.slots(levels, keys) == slots).all()


def test_empty_store(spark):
    store = token_store.write_store(empty(spark), tokenizer_path())
    assert token_store.read_store(store, empty(spark).select("doc_id")).count() == 0


# -- 8 near duplicates ------------------------------------------------------------------


def jaccard_classes(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + near.WORDS]) for k in range(max(1, len(w) - near.WORDS + 1))} if w else set())
    links = collections.defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for a in range(len(rows)):
        if a not in root:
            todo, seen = [a], {a}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            root |= dict.fromkeys(seen, least)
    return collections.Counter((rows[k][0], root[k], len(links[k]), len(sets[k])) for k in range(len(rows)))


@pytest.mark.parametrize("tile", [512, 4])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for k in range(30):
        copy = base[: rng.choice([120, 119, 110, 100])]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"n{k}"
        rows.append((100 + k, " ".join(copy), "en", "x", "y", "z"))
    rows = [*real(40), *rows, *awkward()]
    docs = documents(spark, rows)
    assert collections.Counter(tuple(r) for r in near.join(docs).collect()) == jaccard_classes(rows)


def test_keep_one(spark):
    docs = documents(spark)
    classes = near.join(docs).collect()
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    ids_ = [r.doc_id for r in kept.collect()]
    assert sorted(ids_, key=str) == sorted({(r.class_id) for r in classes if r.n_shingles} | {r.doc_id for r in classes if not r.n_shingles}, key=str)
    assert near.keep_one(empty(spark)).count() == near.join(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    assert set(got) == set(links)
    for a in links:
        todo, seen = [a], {a}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[a] == min(seen)


def test_prefix_depth():
    depth = near.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** near.TREES


# -- 9 pages ----------------------------------------------------------------------------


def test_pages(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(filter(None, blocks))
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<nav>x</nav>", ""), ("just words", "just words"),
    ("<main><h1>A &amp; B</h1><p>one\n  two<b>three</b> four<div class='ad-box'>buy</div><p>five</main><footer>foot</footer>", "A & B\none twothree four\nfive"),
    ("<body><header>top</header><article><p>text one two</p><aside>side</aside><p>more words</p><section id=comments><p>first!</p></section></article>", "text one two\nmore words"),
    ("<p>a</p><script>if (a<b) x='</p>'</script><!-- <p>no</p> --><p>b", "a\nb"),
    ("<article><form><p>mail</p></form><p>x &lt;y&gt;</p><div class=\"cookie notice\">ok?</div></article>", "x <y>"),
])
def test_page_shapes(page, want):
    weights = {html.WORD: 1.0, "p": -0.001, "/p": -0.001, "h1": -0.001, "/h1": -0.001, "article": -6.0, "/article": -6.0}
    assert html.extract(page, weights) == want


def test_best_region():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        lo, hi = html.best_region(scores)
        assert sum(scores[lo:hi]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


# -- 10 decontamination -----------------------------------------------------------------


@pytest.mark.parametrize("window", [13, 4])
def test_decontamination(spark, window):
    text = real(1)[0][1]
    w = words(text)
    items = [(1, " ".join(w[5:40])), (2, " ".join(w[10:13])), (3, None), (4, "..."), (5, " ".join(w[30:60])), (5, " ".join(w[100:120])), (None, " ".join(w[70:90])), (60, "a row without id a row")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    phrases = collections.defaultdict(set)
    for item, body in items:
        iw = words(body)
        size = min(window, len(iw))
        for k in range(len(iw) - size + 1 if iw else 0):
            phrases[tuple(iw[k : k + size])].add(item)
    want = collections.Counter()
    for doc_id, body, *_ in [*real(), *awkward()]:
        dw = words(body)
        hit, found = set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(dw) - size + 1):
                if tuple(dw[k : k + size]) in phrases:
                    hit |= set(range(k, k + size))
                    found |= phrases[tuple(dw[k : k + size])]
        named = sorted(str(x) for x in found if x is not None)
        want[(doc_id, len(dw), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(dw))] += 1
    docs = documents(spark)
    got = decontaminate.report(docs, benchmark, window)
    assert collections.Counter(tuple(r) for r in got.drop("items").collect()) == want
    left = decontaminate.remove(docs, benchmark, window)
    assert left.columns == docs.columns
    assert left.count() == sum(n for r, n in want.items() if not r[-1])
    assert decontaminate.report(left, benchmark, window).where("n_hit > 0").count() == 0 or window == 4
    assert decontaminate.report(empty(spark), benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_benchmark_dealt_to_several_automata(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(decontaminate.automata(benchmark, item_words=200)) > 3
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    column = pa.array([r.text for r in docs.collect()])
    *_, one, found = decontaminate._read(column, decontaminate.automata(benchmark))
    *_, many, found_many = decontaminate._read(column, decontaminate.automata(benchmark, item_words=200))
    assert (one == many).all() and found == found_many
