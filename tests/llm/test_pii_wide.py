"""Wide forms of every kind are added to what the base rules find."""

import random

from odd_tables import frame, prose

from echofold.llm import pii


def card(r):
    d = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def test_planted_wide_forms_are_added(spark):
    r, rows = random.Random(9), []
    for i in range(300):
        c = card(r)
        base = (f"write to u{i}.x@example{i % 7}.com or +49 30 {r.randint(10**6, 10**7 - 1)}, host 10.{i % 250}.3.{r.randint(1, 250)}, "
                f"paid by {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}. ")
        noise = f"Order {r.randint(10**8, 10**9)}, on 2021-{r.randint(10, 12)}-{r.randint(10, 28)}, part {r.randint(1000, 9999)}.{r.randint(1000, 9999)}.{r.randint(1000, 9999)}. "
        rows.append((i, prose(i, 15) + " " + base + prose(i + 999, 12) + " " + noise + prose(i + 5000, 10)))
    c = card(r)
    wide = {"email": "jane.roe (at) mail (dot) example (dot) org", "ip": "2001:db8:0:0:0:0:a00:17", "card": ".".join(c[k:k + 4] for k in (0, 4, 8, 12)), "phone": "tel. 030 555 01234"}
    for k, (kind, form) in enumerate(wide.items()):
        rows.append((1000 + k, f"{prose(k, 12)} {form} {prose(k + 50, 12)}"))
    got = {x.doc_id: x.spans for x in pii.find_pii(frame(spark, rows)).collect()}
    for k, kind in enumerate(wide):
        assert f"{kind}:" in got[1000 + k], (kind, got[1000 + k])
    # Orders, dates and parts without evidence stay.
    assert sum(got[i].count(":") // 2 for i in range(300)) <= 4 * 300 * 1.02


def test_labels_do_not_rest_on_the_base_format():
    def of(text, kind):
        return [pii.label(text, s, pii.base_spans(text)) for s in pii.candidates(text) if s.kind == kind]
    assert 1 in of("tel. 030 555 01234", 3) and 1 not in of("lot 030 555 01234", 3) and 1 in of("ring 0049 30 5550123", 3)
    assert of("a (at) b (dot) org", 0) == [1] and of("IP 10-0-0-7", 1) == [1] and of("section 10-0-0-7", 1) == [0]
    assert of("x 2001:db8:0:0:0:0:a00:17 y", 1) == [1] and of("at 10:20:30:40 y", 1) == [0]
