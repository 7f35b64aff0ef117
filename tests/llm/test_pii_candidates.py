"""Generators of personal data propose every form of their kind, whatever its length and whether or not the text holds a digit."""

import random

import corpus_pipeline
from odd_tables import frame, prose

from echofold.llm import pii


def spans(text, kind):
    return [text[s.start:s.end] for s in pii.candidates(text) if pii.ALL_KINDS[s.kind] == kind]


def test_secrets_of_any_length_with_and_without_digits():
    for n in (16, 200, 201, 5000):
        for key in ("q" * n, "q7" * (n // 2) + "/" * (n % 2)):
            assert spans(f'so token = "{key}" end', "secret") == [key] and spans(f"so {key} end", "secret") == [key]
    # Shorter than a run: where it is assigned to a name, whole, up to the quote or space.
    assert spans("password: hunter2!x.", "secret") == ["hunter2!x"] and spans("user: token=ab.c1&x=1", "secret") == ["ab.c1"]
    assert spans("api_key='abc'", "secret") == ["abc"] and not spans("colour: hunter2!x. token = , secret:", "secret")
    # Without quotes the run has the name in it; the value is proposed too.
    assert "04debebab91ab856" in spans("token=04debebab91ab856", "secret")


def test_short_values_count_in_quotes_or_with_a_digit():
    def of(text):
        return [pii.label(text, s, []) for s in pii.candidates(text) if s.kind == 4]
    assert of("password: hunter2!x.") == of("api_key='abc'") == of("password: correct-horse-battery-staple") == [1]
    assert of("The token: a thing") == of("max_token=4096") == [0]


def test_addresses_without_digits_and_of_any_length():
    assert spans("at fdab:cdef:ab:ab:ab:ab:ab:ab now", "ip") == ["fdab:cdef:ab:ab:ab:ab:ab:ab"]
    assert spans("at fdab:cdef::ab, f :: b, std::beg", "ip") == ["fdab:cdef::ab"]
    assert [pii.label(t, s, []) for t in ("x 2001:db8::1 y", "x A::B y", "ip fe80::a y") for s in pii.candidates(t) if s.kind == 1] == [1, 0, 1]
    name, host = "n" * 70, "h" * 70
    assert spans(f"to {name} (at) {host} (dot) org", "email") == [f"{name} (at) {host} (dot) org"]


def test_texts_without_a_digit_train_and_are_searched(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for i in range(240):
        key = "".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((40, 300))))
        rows.append((i, f"{prose(i, 20)} " + (f'token = "{key}"' if i % 2 else f"{key}") + f" {prose(i + 500, 10)}"))
    rows += [(1000, "to jane.roe (at) mail (dot) org"), (1001, "password: 'abc'"), (1002, "on fdab:cdef:ab:ab:ab:ab:ab:ab")]
    assert not any(pii._ANY_DIGIT(t) for _, t in rows)
    seen, whole = [], pii.boosted.fit
    monkeypatch.setattr(pii.boosted, "fit", lambda blocks, width: seen.append(blocks) or whole(blocks, width))
    got = {x.doc_id: x.spans for x in pii.find_pii(frame(spark, rows)).collect()}
    blocks = seen[0].sparkSession.read.parquet(seen[0].inputFiles()[0].rsplit("/", 1)[0]).collect()
    assert sum(len(b.y) + len(b.rest_y) for b in blocks) == sum(len(pii.candidates(t)) for _, t in rows)
    assert all(("secret:" in got[i]) == bool(i % 2) for i in range(240))


def test_many_candidates_in_a_text_are_told_apart_by_place():
    text = "\n".join(f'u{i}@ex.org 10.0.3.{i % 250} {"abcdefgh" * 3} token = "{"qrstuvwx" * 4}"' for i in range(3000))
    base, added = pii.find_spans(text, pii.boosted.constant(pii.N_FEATURES, 1.0), [0.5] * 5)
    assert len(base) == 6000 and [text[s.start] for s in sorted(added)] == ["a", "q"] * 3000
    kinds = pii._by_kind(base)
    for c in random.Random(2).sample(pii.candidates(text), 300):
        assert sorted(pii._met(c, kinds)) == sorted(b for b in base if pii.meets(c, [b]))


def test_the_stage_replaces_secrets_of_any_length_without_digits(spark):
    r, rows, keys = random.Random(8), [], {}
    for i in range(160):
        keys[i] = "".join(r.choice("abcdefghijklmnop") for _ in range((40, 250)[i // 2 % 2]))
        rows.append((i, f"{prose(i, 20)} " + ('token = "%s"' if i % 2 else "%s") % keys[i] + f" {prose(i + 500, 10)}"))
    for x in corpus_pipeline.personal_data(spark, frame(spark, rows).select(*corpus_pipeline.COLUMNS), "").collect():
        assert (keys[x.doc_id] in x.text) != bool(x.doc_id % 2) and x.n_chars == len(x.text)
        assert x.doc_id % 2 == 0 or 'token = "[SECRET]" ' in x.text
