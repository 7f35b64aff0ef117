"""The operators against brute force, round trips, held-out rows and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_tables import frame, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echofold.llm import (bpe, decontaminate, encode, language_id, near_dups, packing, pii, quality, token_counts, token_files, toxicity, url_filter)

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    return Tokenizer.from_file(path)


def strange_texts(n, seed=3):
    r = random.Random(seed)
    parts = [*"aA b  \n\t\r\x0b\x1c\x85\xa0'stlé1٣ßΣİK我😀!?.\0", "<|endoftext|>", "<|startoftext|>", "aaaa", "'re", "\n\n", " \n", "Word,"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


# Token counts and encoders

@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    t, texts = tokenizer(path), [*strange_texts(3000), prose(4, 3000), ""]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert encode.Encoder(path).ids(texts) == want


def test_encoder_looks_a_repeated_piece_up_once():
    names, at = encode.distinct("\0the quiet the  \nthe quiet \0the é ")
    assert names == ["\0the", "quiet", "the", "", "\nthe", "é"] and at.tolist() == [0, 1, 2, 3, 4, 1, 0, 5]
    assert encode.distinct("")[0] == []
    enc, looked = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    enc.memo = type("Memo", (dict,), {"get": lambda self, p, *d: (looked.append(p), dict.get(self, p, *d))[1]})()
    enc.ids(["a word and a word", "a word", ""] * 50)
    assert sorted(looked) == sorted(set(looked))


def wide_texts(n, seed):
    r = random.Random(seed)
    parts = [*"aZésS \n \n19(×÷,… \u200b\u3000\u0301µªɏɐʀʯˑдוक中가\ufeff\U0001f600\x1f\x7f\t\xa0'", "'ll", "'ve ", " '", '"', "word, ", " été.\n", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_pieces_of_a_column_are_cut_in_its_bytes():
    texts = ["Word, 'they're été! 12km\n\nok \n", "", " ab×c", "x\n"]
    raw = "".join(texts).encode()
    start = np.cumsum([0, *[len(t.encode()) for t in texts]])
    at = encode.cuts(np.frombuffer(raw, np.uint8), start, np.zeros(len(texts), bool)).tolist()
    assert [raw[x:y].decode() for x, y in zip(at, [*at[1:], len(raw)], strict=True)] == [
        "Word", ",", " 'they", "'re", " été", "!", " 12", "km", "\n", "\n", "ok", " \n", " ab×c", "x", "\n"]
    at = encode.cuts(np.frombuffer(raw, np.uint8), start, np.array([True, False, False, True])).tolist()
    assert [raw[x:y].decode() for x, y in zip(at, [*at[1:], len(raw)], strict=True)] == [texts[0], " ab×c", "x\n"]
    raw = "да, нет 中 \U0001f600 б\u3000 \u3000г".encode()
    at = encode.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.array([False])).tolist()
    assert [raw[x:y].decode() for x, y in zip(at, [*at[1:], len(raw)], strict=True)] == ["да,", " нет", " 中", " \U0001f600", " б\u3000 \u3000г"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("model", [True, False])
def test_ids_of_a_column_equal_the_library(path, model, monkeypatch):
    monkeypatch.setattr(encode, "MEMO", 2000)
    t, enc = tokenizer(path), encode.Encoder(path)
    if enc.spaced and not model:
        enc.pieces.model = None
    for seed in range(4):
        texts = [None, *wide_texts(700, seed), *strange_texts(700, seed), prose(4, 300), "", None]
        flat, off = enc.column(pa.array(["left out", *texts], pa.string()).slice(1))
        got = [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)]
        assert got == [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert not enc.spaced or len(enc.pieces.names) <= 2000


def test_a_piece_is_learnt_once():
    enc, learnt = encode.Encoder(BYTE), []
    learn = enc.pieces._learn
    enc.pieces._learn = lambda new: (learnt.extend(new.to_pylist()), learn(new))[1]
    enc.ids(["a word, and a word.", "word"])
    enc.ids(["a word; and\nword,", "a word and 7 words"])
    assert learnt == ["a", " word", ",", " and", " a", ".", "word", ";", "\n", " 7", " words"]


def test_counts_equal_the_library(spark, odd):
    t, texts = tokenizer(BYTE), [*strange_texts(3000, 8), *["a" * n for n in range(40)]]
    assert bpe.Counter(BYTE)(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = sorted(map(tuple, token_counts.count_tokens(odd, BYTE).collect()), key=str)
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in odd_rows()), key=str)
    assert got == want


def test_token_files_round_trip(spark, odd, tmp_path):
    t = tokenizer(BYTE)
    token_files.write_token_files(odd, f"{tmp_path}/f", BYTE)
    got = token_files.read_token_files(spark, f"{tmp_path}/f", with_ids=True).collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in odd_rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    run = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == run and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        run += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_coder_finds_damage():
    r = np.random.default_rng(2)
    sizes = np.array([1, 95, 2048, 2049, 9000])
    flat = np.minimum(r.zipf(1.4, int(sizes.sum())), 5000)
    coder = token_files.Coder(token_files.scaled(np.bincount(flat)))
    records = coder.encode(flat, sizes)
    assert (coder.decode(records)[0] == flat).all()
    bad = bytearray(records[-1])
    bad[-1] ^= 1
    with pytest.raises(ValueError):
        coder.decode([bytes(bad)])
    assert token_files.scaled(np.array([10**9] + [1] * 3000)).sum() == 1 << token_files.SCALE


# Packing

@pytest.mark.parametrize("unit", [packing.UNIT, 3000])
def test_packing_covers_every_id(spark, odd, unit):
    t = tokenizer(WORD)
    got = packing.pack(odd, WORD, unit=unit, with_ids=True).collect()
    windows = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows[r.sequence_id]
        windows[r.sequence_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert max(windows.values()) <= 4096
    assert sum(n & (n - 1) > 0 for n in windows.values()) <= 3  # at most one padded window in each task
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, tuple(r.ids)) for r in got)
    ids = {i: [t.encode(x or "", add_special_tokens=False).ids + [2] for k, x in odd_rows() if k == i] for i in {k for k, _ in odd_rows()}}
    assert sum(len(p[3]) * n for p, n in pieces.items()) == sum(len(v) for vs in ids.values() for v in vs)
    for (doc, n, start, piece), _ in pieces.items():
        assert any(len(v) == n and tuple(v[start:start + len(piece)]) == piece for v in ids[doc])


# Near duplicates

def brute_components(rows, num=85, den=100):
    sets, out = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, set()).update([tuple(w)] if 0 < len(w) < 5 else list(zip(*[w[k:] for k in range(5)])))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for i in ids:
        out[i] = (len(sets[i]), root(i))
    return out


def test_near_dups_equal_brute_force(spark):
    r, rows = random.Random(5), []
    for g in range(12):
        base = prose(100 + g, r.randint(5, 200)).split(" ")
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, ""), (501, None), (502, "a b"), (503, "A  b"), (504, "a"), (505, prose(3, 9000))]
    for chunk in (near_dups.CHUNK, 300):
        docs = frame(spark, rows)
        own = near_dups.signed(docs)
        edges = near_dups.forest_edges(docs, own, 85, 100, chunk=chunk)
        assert edges.columns == ["a", "b"]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_dups_of_odd_rows(spark, odd, empty):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    assert {(x.component_id, x.kept) for x in got if x.doc_id is None} == {(None, True)}
    assert {x.doc_id: x.component_id for x in got if x.doc_id in (1, 2, 3, 4, 5, 8)} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 8: 7}
    assert near_dups.near_duplicates(empty).count() == 0
    kept = near_dups.one_of_each(odd).collect()
    assert Counter(x.doc_id for x in kept) == Counter([1, 3, 4, 5, 6, 7, 7, 9, 10, None, None]) or sum(x.doc_id == 1 for x in kept) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near_dups.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# Quality rules

def test_base_rules():
    f = quality.base_features
    assert f(b"", {}) == (0, 0, 0, 0, 0)
    assert f("é a\né a\n\n \n# $x".encode(), {}) == (6, 7, 2, 1, 0)
    assert f(b"a b c d a b c e", {}) == (8, 8, 0, 0, 6)
    assert f(b"x x x x", {}) == (4, 4, 0, 0, 4)


def test_quality_keeps_clean_and_drops_junk(spark, empty, labels):
    clean = [(i, prose(i, 200)) for i in range(60)]
    junk = [(100 + i, " ".join(w + random.Random(i).choice(["###", "$$$", "&&&"]) for w in prose(i, 120).split())) for i in range(60)]
    known = spark.createDataFrame([(i, int(i < 100)) for i in [*range(30), *range(100, 130)]], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, clean + junk), known).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)
    assert sorted(r.doc_id for r in quality.keep_good(frame(spark, clean + junk), known).collect()) == [i for i, _ in clean]
    assert quality.judge(empty, labels).count() == 0


# Toxicity and language

def test_toxicity_finds_the_sentence(spark, empty, labels):
    r, rows, known = random.Random(2), [], []
    for i in range(300):
        s = [prose(1000 + i * 7 + k, 8).replace("\n", " ") + ". " for k in range(r.randint(1, 9))]
        bad = r.random() < 0.3
        if bad:
            s[r.randrange(len(s))] = f"You are a {r.choice(['grobian', 'grobians', 'rotter'])} indeed. "
        rows.append((i, "".join(s)))
        known.append((i, int(bad)))
    got = toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    truth = dict(known)
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    text = dict(rows)
    assert all(re.search("grobian|rotter", text[x.doc_id][s.start:s.end]) for x in held if truth[x.doc_id] for s in x.sentences)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_language(spark, empty):
    r, rows = random.Random(3), []
    letters = {"xx": "abcde ", "yy": "fghij ", "zz": "ñßøk "}
    for i in range(150):
        lang = r.choice(list(letters))
        rows.append((i, "".join(r.choice(letters[lang]) for _ in range(80)) + "a", lang))
    rows += [(900, None, "xx"), (901, "12 !", "xx"), (902, "fghij fgh", None), (None, "abcd abc", "xx")]
    got = {x.doc_id: x for x in language_id.identify(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:150])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "yy"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language_id.identify(empty).count() == 0
    assert {x.lang_pred for x in language_id.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


# Personal data

def naive_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 13 <= len(g) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(g))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(8000):
        t = "".join(r.choice("ab@.@+-_ 0123456789().é") for _ in range(r.randint(0, 50)))
        assert naive_base(t) == [tuple(s) for s in pii.base_spans(t)]


def test_pii_adds_secrets_and_redacts(spark, empty):
    r, rows = random.Random(4), []
    for i in range(200):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        extra = f' token = "{key}" ' if i % 2 else f" Part number {r.randint(10**5, 10**6)} "
        rows.append((i, prose(i, 20) + extra + "mail a.b@example.com and 10.0.0.1 " + prose(i + 500, 10)))
    rows += [(500, None), (501, "")]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in pii.find_pii(docs).collect()}
    assert all(got[i].n_email == 1 and got[i].n_ip == 1 for i in range(200))
    assert all(("secret:" in got[i].spans) == bool(i % 2) for i in range(200))
    clean = {x.doc_id: x for x in pii.redact(docs).collect()}
    assert clean[500].text is None and clean[501].text == "" and "[SECRET]" in clean[1].text and "example.com" not in clean[1].text
    assert clean[1].n_chars == len(clean[1].text) and pii.redact(docs).columns == docs.columns
    assert pii.find_pii(empty).count() == 0


# URLs

def test_urls(spark):
    urls = [None, "", "no host", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/19", "https://example.org/en/2", "http://com/fr/1", "http://x.com/de/",
            "http://bad.net/spam/1", "ftp://h.net", "http://h.net?x=1", "http://xcom/de/"]
    rows = [(i, u, "<html>", "x", 1) for i, u in enumerate(urls)] + [(None, "http://com/de/1", None, None, None)]
    got = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string, n int")).collect()}
    assert len(got) == len(rows)
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4].rule == "example.org/en/1" and got[5].rule == "org/" and got[6].verdict == "allow" and got[7].verdict == "block"
    assert got[9].path == "" and got[10].host == "h.net" and got[11].rule is None and got[None].verdict == "block"
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none).count() == 0


def test_templates_learn_from_rules(spark):
    rows = [(i, f"http://spam.com/de/{i}") for i in range(50)] + [(100 + i, f"http://spam.com/xx/{i}") for i in range(20)]
    rows += [(200 + i, f"http://good.com/fr/{i}") for i in range(50)] + [(300 + i, f"http://good.com/yy/{i}") for i in range(20)]
    got = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[i].verdict for i in range(100, 120)} == {"block"} and {got[i].verdict for i in range(300, 320)} == {"allow"}


# Decontamination

def test_decontamination(spark, empty):
    items = [(i, prose(50 + i, 40).replace("\n", " ")) for i in range(5)] + [(8, None), (9, ""), (10, "two words"), (11, prose(52, 40).replace("\n", " "))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long_item = items[2][1]
    rows = [(1, prose(1, 100) + " " + items[0][1].upper() + " " + prose(2, 60)), (2, prose(3, 200)), (3, long_item[5:]), (4, None), (5, ""), (None, items[1][1]),
            (6, " ".join(items[3][1].split()[:20])), (7, "here are two words"), (7, "here are two words")]
    docs = frame(spark, rows)
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0), (3, 2), (3, 11), (None, 1), (7, 10)}
    assert sorted(x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()) == [2, 4, 5, 6]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("1 = 0")).count() == len(rows)


def test_simhash_and_blocks(spark):
    """Every pair of fingerprints within the radius has a block within a quarter of it."""
    r = random.Random(6)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            b ^= 1 << k
        masks = set(decontaminate.near_masks(decontaminate.RADIUS // decontaminate.BLOCKS))
        assert any(((a ^ b) >> (16 * k)) & 0xFFFF in masks for k in range(4))
    one = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>").select(decontaminate.simhash(F.col("w")).alias("s"),
                                                                                 F.transform("w", lambda x: F.xxhash64(x)).alias("h")).first()
    bits = [sum((h >> j) & 1 for h in one.h) * 2 > 3 for j in range(64)]
    assert [(one.s >> j) & 1 for j in range(64)] == [int(b) for b in bits]
