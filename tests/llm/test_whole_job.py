"""Cases where an operator once did less than its whole job."""

import collections
import math
import random

import pyarrow as pa
import pytest
from helpers import SOLID, awkward, documents, empty, fold, lower, real
from pyspark.sql import functions as F

from landledger.llm import html, language, ngrams, pii, shared, token_store, tokens
from landledger.llm.queries import tokenizer_path

# -- 6 scoring --------------------------------------------------------------------------


def test_scores_from_token_ngrams(spark):
    rows = [*real(), *awkward()]
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngrams.score(documents(spark), held).collect())
    tokens = [[*SOLID.findall(lower(r[1] or "")), "\n"] for r in rows]
    counts = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        if not fold(r[0], 5, 1):
            s = ["\n", *t]
            counts.update((x,) for x in t)
            counts.update(tuple(s[k : k + n]) for n in range(2, ngrams.ORDER + 1) for k in range(len(s) - n + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def probability(context, x):
        if not context:
            return (counts[(x,)] + 0.5) / (total + 0.5 * (distinct + 1))
        return (counts[(*context, x)] + ngrams.PRIOR * probability(context[1:], x)) / (counts[context] + ngrams.PRIOR)

    want = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        s = ["\n", *t]
        base = sum(math.log10(probability((), x)) for x in t)
        model = sum(math.log10(probability(tuple(s[max(0, k - ngrams.ORDER + 1) : k]), s[k])) for k in range(1, len(s)))
        want[(r[0], fold(r[0], 5, 1), len(t), sum(counts[(x,)] > 0 for x in t), total, round(base, 6), round(model, 6))] += 1
    assert got == want


def test_scores_tell_numbers_apart(spark):
    """All digits were one class: texts that differ in them alone scored alike."""
    rows = [(1, "it rose by 17 points"), (2, "it rose by 17 points"), (3, "it rose by 25 points"), (4, "it rose by 17 points")]
    docs = documents(spark, [(*r, "en", "x", "y", "z") for r in rows])
    got = {r.doc_id: r.score for r in ngrams.score(docs, F.col("doc_id") > 2).collect()}
    assert got[4] > got[3]


def test_scoring_nothing_by_tokens(spark):
    assert ngrams.score(empty(spark), F.lit(False)).count() == 0
    assert ngrams.score(documents(spark, real(2)), F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


# -- 5 language -------------------------------------------------------------------------


def test_sample_is_not_the_first_texts_in_order(spark):
    """Near copies that sort first filled a language's automaton."""
    rng = random.Random(4)
    vocabulary = {x: ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 7))) for _ in range(40)] for x in ("en", "fr")}

    def body(lang):
        return " ".join(rng.choices(vocabulary[lang], k=400))

    rows = [(k, f"aa {k} {'aardvark bazaar ' * 250}", "en") for k in range(20)] + [(100 + k, body(x), x) for k in range(100) for x in ("en", "fr")]
    docs = documents(spark, [(*r, "x", "y", "z") for r in rows])
    parser = language.learn(docs)
    fresh = documents(spark, [(k, body(x), x, "x", "y", "z") for k in range(20) for x in ("en", "fr")])
    assert language.predict(fresh, parser, also={"lang": F.col("lang")}).where("lang <> lang_pred").count() == 0


def test_each_text_gives_as_many_symbols():
    sample = language._cut([chr(0x4E00 + k) * 3000 for k in range(100)])
    assert len(sample) <= language.SAMPLE_SYMBOLS
    shares = collections.Counter(sample[sample > 0].tolist())
    assert len(shares) == 100 and max(shares.values()) - min(shares.values()) <= 1


def test_letters_of_each_language():
    """A language with little text had no letters of its own."""
    import numpy as np

    many = np.repeat(np.arange(1000, 1000 + 2 * language.LETTERS, dtype=np.uint32), 200)
    few = np.repeat(np.arange(5000, 5010, dtype=np.uint32), 3)
    assert set(range(5000, 5010)) <= set(language.Parser({"a": many, "b": few}).known.tolist())


# -- 3 personal data --------------------------------------------------------------------


def test_spans_inside_others_are_replaced_once(spark):
    """The outer span was replaced up to the inner one's start only."""
    want = {"write user+49123456789@example.com now": "write [EMAIL] now", "call +44.20.79.46.0958 now": "call [PHONE] now",
            "to a4111111111111111b@pay.example.org.": "to [EMAIL].", "no span 12": "no span 12"}
    docs = documents(spark, [(k, text, "en", "x", "y", "z") for k, text in enumerate(want)])
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.Tagger()).collect()}
    for k, (text, done) in enumerate(want.items()):
        if len(pii.rule_spans(text)):
            assert got[k] == done
    assert pii.covering([("email", 0, 9), ("phone", 5, 20), ("ip", 20, 27)]) == [("phone", 0, 20), ("ip", 20, 27)]


# -- 1, 7 tokens ------------------------------------------------------------------------

MARKED = ["a <|endoftext|> b", "<|endoftext|>", "one two<|endoftext|>three", "plain words", "<|endoftext|", None]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_are_encoded_like_the_plain_call(plain):
    ids, at = tokens.Encoder(tokenizer_path()).encode(pa.array(MARKED), 0)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*plain(t), 0] for t in MARKED]


def test_added_tokens_in_the_store(spark, plain):
    docs = documents(spark, [(k, text, "en", "x", "y", "z") for k, text in enumerate(MARKED)])
    got = token_store.read_store(token_store.write_store(docs, tokenizer_path()), docs.select("doc_id")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(plain(t)) + 1 for k, t in enumerate(MARKED)}


# -- 9 main text ------------------------------------------------------------------------

BODY = "one two three four five six seven eight nine ten"
WEIGHTS = {html.WORD: 1.0, "p": -0.001, "/p": -0.001, "article": -6.0, "/article": -6.0}


@pytest.mark.parametrize("page", [
    f"<body><div class='page no-sidebar'><article><p>{BODY}</p></article></div></body>",
    f"<div class='content has-sidebar'><p>{BODY}</p></div>",
    f"<div class='post comment-open'><p>{BODY}</p></div>",
    f"<article class='related-story'><p>{BODY}</p></article>",
    f"<div class='sidebar'><div id=widget><p>teaser</p><main class='with-ads'><p>{BODY}</p></main></div></div>",
    f"<p>{BODY}</p><div class='ad'><p>buy this now</p></div>",
    f"<article><p>{BODY}</p></article><div class='comments'><p>{BODY} {BODY} {BODY}</p></div>",
    f"<div class=ad>buy<div class='ad'>now</div></div><div class='post comment-open'><p>{BODY}</p></div><div class='ad'>and this",
    f"<div class=ad><p class=promo>buy</div><p>{BODY}</p>",
])
def test_class_names_do_not_take_the_article_out(page):
    assert html.extract(page, WEIGHTS) == BODY


# -- samples of texts -------------------------------------------------------------------


def test_sample_of_a_table_of_copies(spark):
    """The step came from the rows, copies included: few or none of the different texts were left."""
    rows = [(k, f"text {k % 60}", "en", "x", "y", "z") for k in range(3000)]
    assert len(shared.sample_texts(documents(spark, rows), "text", 40)) == 40
    assert len(shared.sample_texts(documents(spark, rows), "text", 100)) == 60
