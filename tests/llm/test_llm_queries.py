"""Registered queries against their SQL, and each pipeline stage against brute force on its own input."""

import os
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_llm import brute_components, naive_base
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from echofold.llm import catalog, decontaminate, pii, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def duck(con, name):
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        duck(con, t)
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want)
    # A missing value is one thing, whatever type of pandas a column of nothing else gets.
    a, b = (d[cols].astype(object).where(d[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit", "op2_near_dups": "doc_id n_shingles component_id kept",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_url_filter": "page_id host path rule verdict",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6_language_id": "doc_id held_out lang_pred score",
    "op7_toxicity": "doc_id held_out score predicted", "op8_decontamination": "doc_id item_id start n_words similarity",
    "op9_token_files": "doc_id start n_tokens ids_crc32",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op13_whitening": "vec_id component n deviation whitened explained identity_error"}


def test_all_are_registered(spark):
    assert set(catalog.QUERIES) == set(COLUMNS)
    for name, cols in COLUMNS.items():
        if name not in ("op9_token_files", "op2_near_dups", "op11_hard_negatives", "op12_warc", "op13_whitening"):
            df = catalog.QUERIES[name](spark, SF)
            assert set(cols.split()) <= set(df.columns), name


def test_held_out_flags_and_language(spark):
    got = catalog.QUERIES["op6_language_id"](spark, SF).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df().set_index("doc_id").lang
    held = got[got.held_out]
    assert np.mean(held.lang_pred.to_numpy() == lang[held.doc_id].to_numpy()) > 0.95


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SF)
        df.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.toPandas())
    start, good, one, clean, safe, packed = seen
    assert all(list(d.columns) == list(start.columns) for d in (good, one, clean, safe))
    # Quality: the base rules said again, and the mean log ratio as a plain sum.
    ratio, threshold = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def keeps(text):
        raw = text.encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = {x for x, n in Counter(windows).items() if n > 1}
        again = len({i + k for i, x in enumerate(windows) if x in often for k in range(3)})
        codes = [(int.from_bytes(raw[i:i + 4], "big") * 0x9E3779B1 % 2**32) >> 16 for i in range(len(raw) - 3)]
        score = sum(float(ratio[c]) for c in codes) / max(len(codes), 1)
        return len(w) >= 50 and 100 * again <= 50 * len(w) and score >= threshold - 1e-9

    assert sorted(good.doc_id) == sorted(i for i, t in zip(start.doc_id, start.text, strict=True) if keeps(t))
    # Near duplicates.
    comp = brute_components(list(zip(good.doc_id, good.text, strict=True)), *corpus_pipeline.NEAR)
    assert sorted(one.doc_id) == sorted(i for i, (_, c) in comp.items() if i == c)
    # Decontamination.
    con = duckdb.connect()
    con.register("documents", one)
    duck(con, "benchmark")
    bad = set(con.execute(decontaminate.SQL).df().doc_id)
    assert sorted(clean.doc_id) == sorted(set(one.doc_id) - bad)
    # Personal data: no base span is left but what redaction itself puts there; texts without candidates are as they were.
    before = dict(zip(clean.doc_id, clean.text, strict=True))
    for i, t, n in zip(safe.doc_id, safe.text, safe.n_chars, strict=True):
        assert n == len(t) and not naive_base(t)
        assert t == before[i] or pii.candidates(before[i]) or naive_base(before[i])
        if not pii.candidates(before[i]) and not naive_base(before[i]):
            assert t == before[i]
    # Packing: pieces put together are the library's ids.
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in zip(safe.doc_id, safe.text, strict=True):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        mine = packed[packed.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
