"""Personal data: base rules, and candidates judged by boosted trees.

High-recall generators propose spans of four base kinds and of secrets; they overlap, and most
of what they propose for noisy kinds is harmless. Each candidate has features of
its format (length, digits, groups, entropy, checksums) and of its context (the words
before it, the characters around it). Gradient-boosted trees, one ensemble for all kinds,
are trained on the candidates of every distinct text (see `boosted`). Labels do not rest on the
base format alone: besides what the base rules find, a candidate counts that follows a word which
names its kind, that passes the base rule once its form is normalised, or that is assigned to the
name of a secret (a short one in quotes or with a digit, see `named`). Base spans are also rewritten into
the wide forms, as further rows.
The features that define labels or base formats are masked at random in training, so the trees
also judge by the rest. A threshold per kind is calibrated on half of what could be added (rows
that touch no base span), which trains nothing, to the precision `PRECISION`. What passes
and does not touch a base span is added; base spans always stay.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm import boosted
from echofold.llm.boosted import Trees
from echofold.llm.common import small_batches, texts, written
from echofold.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. Fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters from which on a run may be a secret without a name.
RUN = 16
#: Generators: wider than the base patterns.
WIDE = {
    # What follows the name of an address, from its @ on.
    "email": re.compile(r"[ \t]?(?:@|\(at\)|\[at\])[ \t]?[A-Za-z0-9-]+(?:[ \t]?(?:\.|\(dot\)|\[dot\])[ \t]?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:[.-][0-9]{1,3}){3}(?![0-9A-Za-z])|(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
                     r"|(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ .-]?[0-9]{2,6}){2,5}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.])(?:\+|00)?[0-9(][0-9() ./-]{6,20}[0-9](?![0-9A-Za-z])"),
    # A whole run; a shorter one is a candidate where it is assigned to the name of a secret.
    "secret": re.compile(rf"(?<![0-9A-Za-z])[0-9A-Za-z_+/=-]{{{RUN},}}"),
}
#: What every text with a candidate holds, as Spark reads it.
HOLDS = rf"[0-9@=:]|\(at\)|\[at\]|[0-9A-Za-z_+/=-]{{{RUN}}}"
#: Names of secrets, before what is assigned to them; the marks of an assignment that can follow one, and the value after a mark.
NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|auth|credential|private[_-]?key)[\"']?\s*[=:]\s*[\"']?$")
MARK = re.compile(r"(?i)[=:](?<=[dhlnty\"'\s].)")
VALUE = re.compile(r"\s*(?:\"([^\"\s]+)\"|'([^'\s]+)'|([^\s\"'<>,;&]+))")
#: Words that name a kind, before a span of it.
CUES = [re.compile(rf"(?i)(?<![^\W_])(?:{words})(?:[ ]?(?:address|adresse|no|nr|number|is|at))?[\s.:=#>\"'(-]{{0,4}}$") for words in (
    r"e-?mail|mail|correo|courriel|contact|kontakt", r"ip|ipv4|ipv6|ip-addr|host|gateway|addr", r"card|visa|mastercard|amex|karte|carte|tarjeta|iban",
    r"tel|tele?[fp]h?one?|tel[eé]fono|t[eé]l[eé]phone|phone|mobile|m[oó]vil|portable|cell|fax|handy|call|anruf|whatsapp")]
PRECISION = 0.98
#: Score bins of the thresholds, and the most candidates of a block.
SCORES, BLOCK = 1 << 16, 50_000
CONTEXT = 24


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _name_start(text: str, end: int, at: int) -> int:
    """Where the name before an @ starts, not before `end`."""
    while at > end and (text[at - 1] in "._%+-" or (text[at - 1].isascii() and text[at - 1].isalnum())):
        at -= 1
    return at


def _email_spans(text: str):
    """EMAIL from left to right; looked for around each @ so that long runs without one cost nothing."""
    at = text.find("@")
    end = 0
    while at >= 0:
        start = _name_start(text, end, at)
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, leftmost and non-overlapping within each kind, in order of kind and start."""
    out = []
    if "@" in text:
        out += [Span(0, *s) for s in _email_spans(text)]
    if _ANY_DIGIT(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append(Span(1, *m.span()))
        for m in CARD.finditer(text):
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(Span(2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append(Span(3, *m.span()))
    return out


_ANY_DIGIT = re.compile("[0-9]").search
_COLONS = re.compile(":[0-9A-Fa-f]{0,4}:").search


def _wide_emails(text: str):
    """Addresses in any form from left to right: a name of any length before each match of the generator."""
    end = 0
    m = WIDE["email"].search(text)
    while m:
        start = _name_start(text, end, m.start())
        if start < m.start():
            yield start, m.end()
            end = m.end()
        m = WIDE["email"].search(text, end if start < m.start() else m.start() + 1)


def _assigned(text: str):
    """Values assigned to the name of a secret, of any length, from left to right."""
    end = 0
    for m in MARK.finditer(text):
        if m.start() >= end and _hint(text[max(0, m.end() - CONTEXT):m.end()]):
            v = VALUE.match(text, m.end())
            if v:
                start, end = v.span(v.lastindex)
                if v.lastindex == 3:
                    end = start + len(v.group(3).rstrip(".!?()[]{}"))
                if start < end:
                    yield start, end


def candidates(text: str) -> list[Span]:
    """Spans of all generators; they may overlap, but a run inside an assigned value is part of it."""
    out = []
    digit = _ANY_DIGIT(text)
    if "@" in text or "(at)" in text or "[at]" in text:
        out += [Span(0, *s) for s in _wide_emails(text)]
    if digit or _COLONS(text):
        out += [Span(1, *m.span()) for m in WIDE["ip"].finditer(text)]
    if digit:
        for k in (2, 3):
            out += [Span(k, *m.span()) for m in WIDE[ALL_KINDS[k]].finditer(text)]
    values = [Span(4, *s) for s in _assigned(text)]
    out += values
    k = 0
    for m in WIDE["secret"].finditer(text):
        while k < len(values) and values[k].end < m.end():
            k += 1
        if k == len(values) or m.start() < values[k].start:
            out.append(Span(4, *m.span()))
    return out


def cued(kind: int, before: str) -> bool:
    """Whether the words before a span name its kind."""
    return kind < 4 and bool(CUES[kind].search(before))


def normalised(kind: int, t: str) -> bool:
    """Whether a wide form, brought into the base form, is what the base rule of its kind finds."""
    if kind == 0:
        t = re.sub(r"[ \t]?(?:@|\(at\)|\[at\])[ \t]?", "@", t)
        return bool(EMAIL.fullmatch(re.sub(r"[ \t]?(?:\.|\(dot\)|\[dot\])[ \t]?", ".", t)))
    if kind == 1:
        if ":" in t:
            try:
                return bool(ipaddress.IPv6Address(t))
            except ValueError:
                return False
        parts = re.split("[.-]", t)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    d = _digits(t)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == 3 and t.startswith(("+", "00")) and 9 <= len(d.removeprefix("00")) <= 15


def evident(kind: int, before: str, t: str) -> bool:
    """Evidence for a wide form that no base span meets.

    An address in words, an IPv6 of three groups or more and a card with its checksum speak for themselves; four
    numbers with hyphens need the word before them, and so do a shorter IPv6 and a telephone number without its country.
    """
    if kind == 3:
        d = _digits(t)
        return 7 <= len(d) <= 15 and cued(3, before) or normalised(3, t) and d[2:3] != "0" and len(d) < len(t)
    return normalised(kind, t) and (kind != 1 or len(re.findall("[^:]+", t)) > 2 and ":" in t or cued(1, before))


def named(before: str, t: str, after: str) -> bool:
    """Whether a span is assigned to the name of a secret; a short one in quotes, or with a digit among six characters, so that no word counts."""
    return bool(NAMED.search(before)) and (len(t) >= RUN or before[-1:] in "\"'" and after == before[-1:] or len(t) >= 6 and bool(_ANY_DIGIT(t)))


def _hint(words: str) -> float:
    return float(bool(NAMED.search(words)))


def features(text: str, s: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    t, before, after = text[s.start:s.end], text[max(0, s.start - CONTEXT):s.start], text[s.end:s.end + 2]
    d = _digits(t)
    n = len(t)
    count = Counter(t)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    upper = sum(c.isupper() for c in t)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in t)
    groups = re.findall("[0-9]+", t)
    octets = float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups))
    return [s.kind, n, len(d), len(d) / n, entropy, upper / n, hexes / n, len(groups), max(map(len, groups), default=0), float(t[0] == "+"),
            t.count("."), t.count("-"), t.count(" "), float("@" in t), float(13 <= len(d) <= 19 and luhn(d)), octets,
            _hint(before), float(before[-1:] in "\"'=:"), float(after[:1] in "\"'"), float(before[-1:].isalnum()), float(after[:1].isalnum()),
            float(_ANY_DIGIT(before) is not None), float("(" in t), float(9 <= len(d) <= 15),
            float(cued(s.kind, before)), float(normalised(s.kind, t))]


N_FEATURES = 26
#: Features that define a label or a base format and are masked at random in training: the leading +, dots, @, checksum,
#: octets, the name or word before it, the base rule on the normalised form.
DEFINING = (9, 10, 13, 14, 15, 16, 24, 25)


def meets(s: Span, base: list[Span]) -> bool:
    return any(b.start < s.end and s.start < b.end for b in base)


def _by_kind(base: list[Span]) -> list[list[Span]]:
    return [[b for b in base if b.kind == k] for k in range(len(KINDS))]


def _met(s: Span, kinds: list[list[Span]]) -> list[Span]:
    """The base spans that a span meets; those of a kind are in order and do not overlap."""
    out = []
    for own in kinds:
        for k in range(bisect_right(own, s.start, key=lambda b: b.end), len(own)):
            if own[k].start >= s.end:
                break
            out.append(own[k])
    return out


def label(text: str, s: Span, base: list[Span]) -> int:
    """1: the base rule of its kind finds it, or it is evident where no base span is, or assigned to the name of a secret; else 0."""
    before = text[max(0, s.start - CONTEXT):s.start]
    if s.kind == 4:
        return int(named(before, text[s.start:s.end], text[s.end:s.end + 1]))
    if meets(s, base):
        return int(meets(s, [b for b in base if b.kind == s.kind]))
    return int(evident(s.kind, before, text[s.start:s.end]))


def wide_form(kind: int, t: str) -> str:
    """A base span written as the base rules do not find it; which way follows from its own hash."""
    way = zlib.crc32(t.encode()) % 2
    if kind == 0:
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"))[way]
        name, host = t.split("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        octets = [int(p.lstrip("0") or 0) for p in t.split(".")]
        return ("IP " + "-".join(map(str, octets)), "2001:db8:0:0:0:0:{:x}:{:x}".format(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3]))[way]
    d = _digits(t)
    if kind == 2:
        return ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return ("tel. 0" + " ".join((d[2:5], d[5:8], d[8:])).strip(), "00" + t[1:])[way]


def _rewritten(text: str, base: list[Span]):
    """(text, candidate) for wide forms of the base spans, each in the surroundings of its own."""
    for b in base:
        before = text[max(0, b.start - CONTEXT):b.start]
        new = wide_form(b.kind, text[b.start:b.end])
        local = before + new + text[b.end:b.end + CONTEXT]
        at = base_spans(local)
        for c in candidates(local):
            if c.kind == b.kind and c.start < len(before) + len(new) and len(before) < c.end and not meets(c, at):
                yield local, c


def _chance(salt: np.ndarray, k: int) -> np.ndarray:
    """A number in [0, 1) for each salt, another for each k."""
    v = (salt.astype(np.uint64) << np.uint64(8)) + np.uint64(k + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(by)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _gathered(batches):
    """Blocks of candidates as features and labels: what trains, masked, and what calibrates.

    What meets a base span trains; of what could be added, half calibrates. Which half and what is
    masked follows from the text and the candidate's place in it.
    """
    def block(rows, ys, free, salts):
        x, y, salt = np.array(rows, dtype="<f4").reshape(-1, N_FEATURES), np.array(ys, dtype=np.uint8), np.array(salts, dtype=np.uint64)
        rest = np.array(free, dtype=bool) & (_chance(salt, N_FEATURES) >= 0.5)
        seen, salt = x[~rest], salt[~rest]
        for f in DEFINING:
            seen[_chance(salt, f) < 0.3, f] = 0.0
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (seen, y[~rest], x[rest], y[rest])], ["x", "y", "rest_x", "rest_y"])

    held = [], [], [], []
    for b in batches:
        for text in texts(b):
            base, salt = base_spans(text), zlib.crc32(text.encode())
            kinds = _by_kind(base)
            own = [(text, c, _met(c, kinds)) for c in sorted(candidates(text))]
            for k, (t, c, known) in enumerate(own + [(t, c, []) for t, c in _rewritten(text, base)]):
                for part, v in zip(held, (features(t, c), label(t, c, known), not meets(c, known), salt << 20 | k % (1 << 20)), strict=True):
                    part.append(v)
                if len(held[0]) == BLOCK:
                    yield block(*held)
                    held = [], [], [], []
    if held[0]:
        yield block(*held)


def _scored(trees):
    """Counts of what calibrates by kind, score bin and label."""
    def run(batches):
        for b in batches:
            for raw, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4").reshape(-1, N_FEATURES).astype(float)
                at = np.minimum((trees.value.score(x) * SCORES).astype(np.int64), SCORES - 1)
                rows, n = np.unique(np.stack([x[:, 0].astype(np.int64), at, np.frombuffer(y, np.uint8).astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(r) for r in rows], pa.array(n)], ["kind", "bin", "y", "n"])
    return run


def fit(docs: DataFrame) -> tuple[Trees, list[float]]:
    """Trees and a threshold per kind from the candidates of every distinct text.

    What reaches the driver: sums by node, feature and bin, and counts by kind and score bin.
    """
    # One of each text is enough, so copies cannot outweigh the rest.
    own = docs.where(F.col("text").rlike(HOLDS)).select("text").distinct()
    blocks = written(own.mapInArrow(_gathered, "x binary, y binary, rest_x binary, rest_y binary"), "candidates")
    trees = boosted.fit(blocks.select("x", "y"), N_FEATURES)
    share = docs.sparkSession.sparkContext.broadcast(trees)
    got = (blocks.select("rest_x", "rest_y").mapInArrow(_scored(share), "kind long, bin long, y long, n long")
           .groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).orderBy("kind", F.desc("bin")).toPandas())
    limits = []
    for k in range(len(ALL_KINDS)):
        mine = got[got["kind"] == k]
        precise = mine["good"].cumsum() >= PRECISION * mine["n"].cumsum()
        if mine["good"].sum() and precise.any():
            limits.append(max(0.5, float(mine["bin"][precise].iloc[-1]) / SCORES))
        else:
            limits.append(1.0)
    return trees, limits


def find_spans(text: str, trees: Trees, limits: list[float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and the ones added to them, without overlap among the added."""
    base = base_spans(text)
    kinds = _by_kind(base)
    cand = [c for c in candidates(text) if not _met(c, kinds)]
    if not cand:
        return base, []
    p = np.concatenate([trees.score(np.array([features(text, c) for c in cand[i:i + BLOCK]], dtype=np.float32).astype(float)) for i in range(0, len(cand), BLOCK)])
    added, taken = [], []
    for i in sorted(range(len(cand)), key=lambda i: (-p[i], cand[i])):
        c = cand[i]
        if p[i] > limits[c.kind] - 1e-12 and limits[c.kind] < 1.0:
            k = bisect_left(taken, (c.end,))
            if k == 0 or taken[k - 1][1] <= c.start:
                taken.insert(k, (c.start, c.end))
                added.append(c)
    return base, added


def _written(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{ALL_KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _find(model, clean: bool):
    def run(batches):
        trees, limits = model.value
        for b in batches:
            n, sha, spans, new = [], [], [], []
            for t in texts(b):
                base, added = find_spans(t, trees, limits)
                n.append([sum(s.kind == k for s in base) for k in range(4)])
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written([*base, *added]))
                if clean:
                    new.append(redacted(t, [*base, *added]))
            n = np.array(n, dtype=np.int64).reshape(-1, 4)
            cols = [b.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            if clean:
                whole = b.column(1).is_valid()
                cols.append(pa.array([t if ok else None for t, ok in zip(new, whole.to_pylist(), strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def find_pii(docs: DataFrame, clean: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with `clean` the redacted text too.

    spans lists base and added spans as kind:start:end in code points, by kind as in ALL_KINDS, then
    start. A NULL or empty text has none, and stays NULL or empty. Rows are read one by one.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", text string" if clean else ""
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(
        _find(model, clean), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string{more}")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced, all columns; n_chars, where there is one, is counted anew."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("text")))

    def run(batches):
        trees, limits = model.value
        for b in batches:
            at, k = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            valid = b.column(at).is_valid().to_pylist()
            new = [redacted(t, [s for part in find_spans(t, trees, limits) for s in part]) if ok else None for t, ok in zip(texts(b), valid, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if k >= 0:
                cols[k] = pa.array([None if t is None else len(t) for t in new], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


@query("op3_pii")
def op3_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
