"""Cross-entropy difference against counting by hand."""

import math
from collections import Counter

import pytest

from loomline.llm import lm_scoring
from loomline.session import ship_package

ROWS = [(1, "a b a b c", 0), (2, "a b a", 0), (3, "c d é d", 1), (3, "c d é d", 1), (4, None, 0), (5, " \n", 0), (None, "b a", 2)]


def brute(rows, target, weight=0.6):
    models = []
    for keep in (lambda i: True, lambda i: i in target):
        word, context, pair = Counter(), Counter(), Counter()
        for i, t, _ in rows:
            last = ""
            for w in (t or "").split() if keep(i) else []:
                word[w] += 1
                context[last] += 1
                pair[last, w] += 1
                last = w
        models.append((word, context, pair))
    kinds = len(models[0][0]) + 1
    for i, t, _ in rows:
        words, loss = (t or "").split(), []
        for word, context, pair in models:
            total, last = 0.0, ""
            for w in words:
                p = (word[w] + 0.5) / (sum(word.values()) + 0.5 * kinds)
                total -= math.log(weight * (pair[last, w] / context[last] if context[last] else p) + (1 - weight) * p)
                last = w
            loss.append(total / len(words) if words else None)
        yield i, len(words), loss[1], loss[0]


@pytest.mark.parametrize("target", [[2, 2, None], [3], []])
def test_score(spark, target):
    ship_package(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score int")
    ids = spark.createDataFrame([(x,) for x in target], "doc_id long")
    got = sorted(lm_scoring.score(docs, ids).collect(), key=lambda r: (r.id is None, r.id))
    want = sorted(brute(ROWS, [x for x in target if x is not None]), key=lambda r: (r[0] is None, r[0]))
    for g, w in zip(got, want, strict=True):
        assert (g.id, g.n_tokens) == w[:2]
        if g.n_tokens:
            assert g.loss_target == pytest.approx(w[2]) and g.loss_background == pytest.approx(w[3])
            assert g.score == pytest.approx(w[3] - w[2])
        else:
            assert g.loss_target is None and g.score is None
    assert lm_scoring.score(docs.limit(0), ids).count() == 0
