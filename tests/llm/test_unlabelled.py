import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from formspark.llm import toxicity

fold = lambda i: i % 3


@pytest.mark.parametrize("added", [64, 1])
def test_sums_over_all_rows_equal_the_fit_in_one_place(spark, monkeypatch, added):
    """Risks and gradients summed by tasks, of rows grouped with counts, give fit_nnpu's classifiers."""
    monkeypatch.setattr(toxicity, "ADDED", added)
    rng, d = np.random.default_rng(2), 40
    toxic = [np.unique(np.append(rng.integers(0, 6, 2), rng.integers(0, d, 3))) for _ in range(60)]
    rows = [(i % 3, np.unique(rng.integers(0, d, 3 * (i % 2)))) for i in range(150)] + [(i % 3, f) for i, f in enumerate(toxic[:20])]
    masks = [(k, toxicity.lifted([f for i, f in enumerate(toxic) if i % 3 != k], [f for j, f in rows if j != k], d, least)) for least in (1.0, 3.0) for k in range(3)]
    counted = Counter((k, f.astype("<i4").tobytes()) for k, f in rows)
    sets = spark.createDataFrame([(k, bytearray(f), n) for (k, f), n in counted.items()], "fold int, f binary, n long").repartition(5)
    own = [[f for i, f in enumerate(toxic) if i % 3 != k] for k in range(3)]
    got = toxicity.fit_nnpu_spread(own, sets, [sum(j != k for j, _ in rows) for k in range(3)], 0.2, masks, steps=25)
    for nth, (k, mask) in enumerate(masks):
        w, b = toxicity.fit_nnpu(own[k], [f for j, f in rows if j != k], 0.2, steps=25, rate=toxicity.RATE, dims=d, least=(1.0, 3.0)[nth // 3])
        assert mask.any() and np.allclose(got[nth][0], w, atol=1e-8) and abs(got[nth][1] - b) < 1e-8


def test_counts_and_sets_cover_every_row(spark):
    """Null, empty, repeated and very long texts count like any other; features outside the mask don't."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(4))) for _ in range(90)] + [None, "", "alpha", "alpha", "x" * 9 + " y" * 30000 + " beta"]
    rows = list(enumerate(texts)) + [(5, "alpha beta")] * 40
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, f string").repartition(6)
    words = {w: toxicity.features(pa.array([w]))[1] for w in ("alpha", "beta")}
    mask = np.zeros(toxicity.DIMS, bool)
    mask[np.concatenate(list(words.values()))] = True
    of = lambda t: [f for f in toxicity.features(pa.array([t]))[1] if mask[f]]
    df, n = toxicity.unlabelled_counts(docs, mask, fold, 3)
    want = Counter((fold(i), f) for i, t in rows for f in of(t))
    assert {(k, f): df[k, f] for k, f in np.argwhere(df)} == dict(want) and n.tolist() == [sum(fold(i) == k for i, _ in rows) for k in range(3)]
    place = np.cumsum(mask) - 1
    sets = Counter((fold(i), tuple(place[f] for f in of(t))) for i, t in rows)
    assert {(r.fold, tuple(np.frombuffer(r.f, "<i4"))): r.n for r in toxicity.unlabelled_sets(docs, mask, fold).collect()} == dict(sets)
    df, n = toxicity.unlabelled_counts(docs.limit(0), mask, fold, 3)
    assert not df.any() and not n.any() and toxicity.unlabelled_sets(docs.limit(0), mask, fold).collect() == []
