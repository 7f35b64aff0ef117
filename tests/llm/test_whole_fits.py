"""Models and thresholds rest on all rows, not on a bounded number of them."""

import numpy as np

from echofold.llm import boosted, pii, quality


def test_quality_counts_every_labelled_text(spark):
    n = 20_500  # of each class
    rows = [(i, f"{'good' if i < n else 'junk'} text {i * 7919 % 99991}") for i in range(2 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(2 * n).selectExpr("id as doc_id", f"cast(id < {n} as int) as quality")
    ratio, threshold = quality.fit(docs, labels)
    count = lambda part: np.bincount(quality.grams([t.encode() for _, t in part], quality.BUCKETS)[0], minlength=quality.BUCKETS) + quality.SMOOTH
    raw, trusted = count(rows), count(rows[:n])
    np.testing.assert_allclose(ratio, np.log(trusted / trusted.sum()) - np.log(raw / raw.sum()), rtol=1e-12)
    score = quality._mean_ratio([t.encode() for _, t in rows], ratio)
    assert (score[:n] >= threshold).all() and (score[n:] < threshold).all()


def test_pii_trains_on_every_candidate(spark, monkeypatch):
    # One text with more candidates than a bounded number per text would take, and many texts.
    rows = [(0, " ".join(f"id {i:07d}x{i * 7919 % 10**9:09d}" for i in range(300)))]
    rows += [(i, f'text {i} token = "{i * 2654435761 % 16**10:040x}" end') for i in range(1, 100)]
    rows += [(1000, rows[5][1]), (1001, None)]
    seen = []
    whole = pii.boosted.fit
    monkeypatch.setattr(pii.boosted, "fit", lambda blocks, width: seen.append(blocks) or whole(blocks, width))
    pii.fit(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    want = sum(len(pii.candidates(t)) + len(list(pii._rewritten(t, pii.base_spans(t)))) for t in {t for _, t in rows if t})
    blocks = spark.read.parquet(seen[0].inputFiles()[0].rsplit("/", 1)[0]).collect()
    assert sum(len(b.y) + len(b.rest_y) for b in blocks) == want == 399
    assert all(len(b.x) == 4 * pii.N_FEATURES * len(b.y) for b in blocks)


def test_trees_do_not_depend_on_the_deal_of_rows(spark, rng):
    x = rng.normal(size=(6000, 3)).astype("<f4")
    x[:, 2] = np.round(x[:, 2])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(np.uint8)

    def fitted(order, parts):
        blocks = [(x[i].tobytes(), y[i].tobytes()) for i in np.array_split(order, parts)]
        return boosted.fit(spark.createDataFrame(blocks, "x binary, y binary").repartition(3), 3)

    a, b = fitted(np.arange(6000), 2), fitted(rng.permutation(6000), 9)
    assert (a.score(x.astype(float)) == b.score(x.astype(float))).all()
    assert ((a.score(x.astype(float)) > 0.5) == y).mean() > 0.95
    one = spark.createDataFrame([(x.tobytes(), np.ones(6000, np.uint8).tobytes())], "x binary, y binary")
    assert boosted.fit(one, 3).score(x.astype(float)).min() > 0.99
