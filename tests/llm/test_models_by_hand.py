"""The inference of the two text models against plain Python, word by word and passage by passage."""

import math
import random

import numpy as np

from strandline.llm import language_mixture as lm
from strandline.llm import passage_quality as pq

TEXTS = ["", "The cat, the DOG!", "12 !!", "straße über äpfel und der hund", "the and ofé der die das 7 le la les", "a", "x" * 700 + " y", "Line one\nline two\nLINE ONE!?"]


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def word_likelihoods(text, model, scaled=True):
    """For each word, the product over its letters' trigrams in every language, as logs."""
    low = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    out = []
    for i, b in enumerate(low):
        if b == 32:
            continue
        before, after = low[i - 1] if i else 32, low[i + 1] if i + 1 < len(low) else 32
        code = ((before << 16 | b << 8 | after) * 2654435761 % 2**32) >> (32 - lm.BITS)
        if before == 32:
            out.append([0.0] * len(model.languages))
        out[-1] = [x + float(t) for x, t in zip(out[-1], model.table[code])]
    return [[math.exp(x - max(w)) for x in w] for w in out] if scaled else out


def em(words, share, steps):
    for _ in range(steps):
        sums = [0.0] * len(share)
        for w in words:
            total = sum(l * s for l, s in zip(w, share))
            sums = [x + l * s / total for x, l, s in zip(sums, w, share)]
        share = [x / len(words) for x in sums]
    return share, sum(math.log(sum(l * s for l, s in zip(w, share))) for w in words)


def mixture_by_hand(text, model):
    words, k = word_likelihoods(text, model), len(model.languages)
    if not words:
        return [0.0] * k
    share, _ = em(words, [1 / k] * k, lm.STEPS)
    order = sorted(range(k), key=lambda j: -share[j])
    best, chosen = -math.inf, share
    for n in range(1, k + 1):
        kept = [max(share[j], 1e-12) if j in order[:n] else 0.0 for j in range(k)]
        part, fit = em(words, [x / sum(kept) for x in kept], lm.REFITS if n > 1 else 0)
        if fit - lm.PENALTY * n * math.log(len(words) + 1) > best:
            best, chosen = fit - lm.PENALTY * n * math.log(len(words) + 1), part
    return chosen


def test_mixtures_equal_those_by_hand():
    rng = np.random.default_rng(3)
    counts = rng.gamma(0.3, 5, (1 << lm.BITS, 5)) + 0.5
    model = lm.Model(list("abcde"), np.log(counts / counts.sum(0)).astype(np.float32))
    letters = random.Random(4)
    texts = TEXTS + ["".join(letters.choice("abcdeé  ,") for _ in range(n)) for n in (5, 40, 200, 900)]
    got = lm.mixtures(model, *packed(texts))
    for row, text in zip(got, texts):
        assert np.allclose(row, mixture_by_hand(text, model), atol=1e-9)


def test_stage_keeps_balanced_mixtures_and_drops_what_no_language_explains(spark):
    words = {"en": "the house was there before them", "fr": "une maison avec beaucoup de fenêtres", "de": "das haus steht schon lange über"}
    rows = [(k * 10 + i, lang, " ".join([text] * 5)) for k, (lang, text) in enumerate(words.items()) for i in range(9)]
    mixed = " ".join(words.values())
    docs = spark.createDataFrame([*rows, (100, None, mixed), (101, None, "qxzj vkqw zzxq jjqv " * 9), (102, None, "12 34"), (103, None, None)], "doc_id long, lang string, text string")
    kept = {r["doc_id"] for r in lm.identified(spark, docs).collect()}
    assert kept == {r[0] for r in rows} | {100}
    model = lm.learn(lm.training_rows(docs))
    (share,), (mean,) = lm.fitted_mixtures(model, *packed([mixed]))
    assert (share > 0.2).all()
    logs = word_likelihoods(mixed, model, scaled=False)
    assert np.isclose(mean, sum(math.log(sum(math.exp(x) * s for x, s in zip(w, share))) for w in logs) / sum(len(c.encode()) for c in mixed if c.isalpha()))
    assert not lm.identified(spark, docs.limit(0)).count()


def features_by_hand(text):
    """Of each passage: roots of the shares of classes, log length, repeats, mean word length, different words."""
    data, out = text.encode(), []
    words, at = [], None
    for i, b in enumerate([*data, 32]):
        space = b == 32 or 9 <= b <= 13
        if at is None and not space:
            at = i
        elif at is not None and space:
            words.append((at, data[at:i].lower()))
            at = None
    for a in range(0, max(len(data), 1), pq.PASSAGE):
        passage = data[a : a + pq.PASSAGE]
        row = [math.sqrt(sum(pq.CLASS[b] == c for b in passage) / max(len(passage), 1)) for c in range(pq.CLASSES)] + [math.log1p(len(passage))]
        mine = [k for k, (start, _) in enumerate(words) if a <= start < a + pq.PASSAGE]
        n = max(len(mine), 1)
        row.append(sum(k > 0 and words[k][1] == words[k - 1][1] for k in mine) / n)
        row.append(math.log1p(sum(len(words[k][1]) for k in mine) / n) if words else 0.0)
        out.append([*row, len({words[k][1] for k in mine}) / n])
    return out


def score_by_hand(model, text):
    w, hidden, gates = model.weights, [], []
    for x in features_by_hand(text):
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale)]
        h = [math.tanh(sum(v * c for v, c in zip(x, column)) + b) for column, b in zip(w["W"].T, w["b"])]
        gate = [math.tanh(sum(a * b for a, b in zip(h, v))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u)))) for v, u in zip(w["V"].T, w["U"].T)]
        hidden.append(h)
        gates.append(math.exp(sum(g * a for g, a in zip(gate, w["a"]))))
    z = [sum(g * h[j] for g, h in zip(gates, hidden)) / sum(gates) for j in range(pq.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * c for a, c in zip(z, w["c"])) - float(w["d"])))


def test_attention_scores_equal_those_by_hand():
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "gamma!", "7", "é"]) for _ in range(n)) for n in (10, 300, 900)]
    x, first = pq.encode(*packed(texts))
    assert np.allclose(x, [row for t in texts for row in features_by_hand(t)], atol=1e-6)
    model = pq.fit(x.astype(float), first[:-1], np.array([float(k % 2) for k in range(len(texts))]))
    assert np.allclose(model.scores(x, first), [score_by_hand(model, t) for t in texts], atol=1e-5)


def test_a_worker_drops_the_memos_of_other_tasks():
    from functools import lru_cache

    from strandline.llm.common import trimmed

    made = lru_cache(1)(lambda: object())
    with_memo, without = trimmed(lambda batches: iter([made()]), made), trimmed(lambda batches: iter([]))
    first, *_ = with_memo(iter([]))
    assert [*with_memo(iter([]))] == [first]
    assert not [*without(iter([]))]
    assert [*with_memo(iter([]))] != [first]
