"""The near_dedup stage takes pairs from 0.80 on; op2 stays at 0.85."""

import os
import sys

from odd_tables import frame
from test_llm import prose

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from echofold.llm import near_dups  # noqa: E402


def with_tail(i, common, own):
    """A text and a copy with another end: common shingles, own more in each."""
    base = [f"w{i}x{k}" for k in range(common + 4)]
    return [" ".join(base + [f"{side}{i}x{k}" for k in range(own)]) for side in "ab"]


def test_stage_takes_pairs_from_080(spark):
    # 160 of 160 + 2 * own shingles: 0.80 at 20, 0.833 at 16, 0.851 at 14, just below 0.80 at 21.
    rows, gone, thin = [], [], []
    for i in range(10):
        for own in (14, 16, 20, 21):
            n = len(rows)
            rows += [(n + k, t) for k, t in enumerate(with_tail(n, 160, own))]
            gone += [n + 1] if own <= 20 else []
            thin += [n + 1] if own == 14 else []
    rows.append((len(rows), prose(3, 100)))
    ids = {i for i, _ in rows}
    docs = frame(spark, rows)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert ids - kept == set(gone)
    assert {r.doc_id for r in near_dups.near_duplicates(docs).where("not kept").collect()} == set(thin)


def test_agreements_follow_the_threshold():
    assert near_dups.matches_for(85, 100) == 39 and near_dups.matches_for(80, 100) == 35
