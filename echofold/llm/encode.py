"""Ids of whole texts by the tokenizers library, each distinct piece encoded once.

Texts repeat their words. Texts are cut where pre-tokens cannot cross and their
pieces dictionary-encoded by Arrow, so Python handles a distinct piece of a batch once. Those that
are new go through the library joined together, a bounded memo holds their ids, and
the ids of the texts are gathered by piece. Texts that cannot be
cut this way go through the library whole. A worker keeps its memo from task to task.

Byte-level vocabularies take the column as it is: `Pieces` finds the cuts in its
bytes, and the memo is a column too, which Arrow numbers before the pieces of the
batch, so that only new pieces become Python objects.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from echofold.llm.bpe import LATIN, MARKS, byte_alphabet
from echofold.llm.common import offsets

MEMO = 800_000
LONG = 64
JOINED = 20_000
#: Pieces whose ids are gathered at once.
GATHER = 1 << 16
#: Taken for white space by str.split, but not by the library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: New pieces of a column that go through the library as one text, and as one word of its model.
TOGETHER = 2_000
WORD = 50
#: The sign of a space in a byte-level vocabulary.
SHOWN_SPACE = "Ġ"
#: White space of any Unicode version, and what is taken for it somewhere, in a class of Arrow's regular expressions.
SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A space and letters, a space and digits, or a space and other signs but the apostrophe: one pre-token each.
PLAIN = r"^ (?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"
#: Kind of the character a byte belongs to, where the byte tells: 1 a letter up to U+024F, 2 a digit, 3 another visible ASCII character,
#: 4 one of another script whose first byte no white space has, 0 anything else.
KIND = np.zeros(256, dtype=np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[0xC3:0xCA] = 1  # the first byte of U+00C0 to U+027F; U+0250 on are letters too
KIND[0xCA:0xE1] = KIND[0xE4:0xEF] = KIND[0xF0:0xF5] = 4


def distinct(parts: str) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of a string in which a space follows every piece, and the number of each piece among them."""
    raw = parts.encode()
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x20) + 1
    col = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw))
    got = col.dictionary_encode()
    return pc.ascii_rtrim(got.dictionary, " ").to_numpy(zero_copy_only=False).tolist(), got.indices.to_numpy()


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind (as in KIND) of the character of every byte."""
    kind = KIND[raw]
    kind[1:] |= raw[:-1] - np.uint8(0xC3) < 7
    signs = np.flatnonzero((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # × and ÷
    signs = signs[raw[signs] == 0xC3]
    kind[signs] = kind[signs + 1] = 0
    wide = np.flatnonzero(kind == 4)
    for k, least in ((1, 0xCA), (2, 0xE0), (3, 0xF0)):
        kind[wide[raw[wide] >= least] + k] = 4
    return kind


def cuts(raw: np.ndarray, start: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that begin at `start` (the end is the last of them); `whole` marks texts not to cut.

    A pre-token of the public pattern ends where a character of one kind (1 to 3) follows one of
    another, but for letters after an apostrophe; before a space or newline with a visible
    character beside it; and between a newline and a visible character.
    """
    first, n = start[:-1][np.diff(start) > 0], len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds(raw)
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (before != after) & (before - np.uint8(1) < 3) & (after - np.uint8(1) < 3) & ((raw[:-1] != 0x27) | (after != 1))
    head = np.append(kind, np.uint8(0))
    head[first] = 0  # the end of a text is as white space for what precedes it
    gap = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    seen = head[gap + 1] > 0
    cut[gap[seen | (kind[gap - 1] > 0)]] = True
    cut[gap[seen & (raw[gap] == 0x0A)] + 1] = True
    for k in np.flatnonzero(whole):
        cut[start[k]:start[k + 1]] = False
    cut[first] = True
    return np.flatnonzero(cut)


class Pieces:
    """Ids of a column of texts for a byte-level vocabulary. The memo: `names`, their ids flat and offsets, and the batch that used each last."""

    def __init__(self, path: str, tok, kind: np.dtype, edge: np.ndarray, special: list[str]):
        self.tok, self.kind, self.edge, self.special = tok, kind, edge, special
        self.newline = tok.encode("\n", add_special_tokens=False).ids
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.model = self._model(path)
        self.names, self.flat, self.off = pa.array([], pa.large_string()), np.zeros(0, kind), np.zeros(1, np.int64)
        self.used, self.batch = np.zeros(0, np.int64), 0

    def _model(self, path: str):
        """The library's model without its search for pre-tokens; None if a merge may join a space to a plain piece before it, or a word is more than its merges."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "fuse_unk", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        plain = {self.shown[b] for b in [*range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            if b[0] == SHOWN_SPACE and a[-1] != SHOWN_SPACE and plain.issuperset(a):
                return None
        return Tokenizer(self.tok.model)

    def _words(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces, several as one word: no merge crosses the space that each begins with."""
        start = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset:part.offset + len(part) + 1]
        shown = part.buffers()[2][start[0]:start[-1]].to_pybytes().decode("latin-1").translate(self.shown)
        end = [*(start[::WORD] - start[0]).tolist(), len(shown)]
        got = self.model.encode_batch_fast([shown[x:y] for x, y in zip(end[:-1], end[1:], strict=True) if x < y], add_special_tokens=False)
        return self._parted(np.concatenate([np.array(e.ids, dtype=self.kind) for e in got]), len(part))

    def _parted(self, ids: np.ndarray, n: int, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n pieces that begin with a space, or that follow the id `end` each, which is left out; and how many each has."""
        at = np.flatnonzero(self.edge[ids] if end is None else ids == end)
        if len(at) != n or at[0]:
            raise ValueError("words of a joined text cannot be told apart with this vocabulary")
        size = np.diff(np.append(at, len(ids)))
        return (ids, size) if end is None else (np.delete(ids, at), size - 1)

    def _special(self, col: pa.Array) -> np.ndarray:
        got = np.zeros(len(col), dtype=bool)
        for s in self.special:
            got |= pc.match_substring(col, s).to_numpy(zero_copy_only=False)
        return got

    def _together(self, part: list[str], join: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces encoded as one text: each begins with a space, or a newline is put before each; None if they have to be encoded alone."""
        text = join + join.join(part)
        if any(s in text for s in self.special):
            return None
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
        return self._parted(ids, len(part), self.newline[0] if join else None)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces, flat, and how many each has."""
        match = lambda p: pc.match_substring_regex(new, p).to_numpy(zero_copy_only=False)
        special = self._special(new)
        spaced, bare = match(f"^ [^{SPACE}]+$") & ~special, match(f"^[^{SPACE}]+$") & ~special
        if len(self.newline) != 1:
            bare[:] = False
        places, flats, sizes = [], [], []
        plain = match(PLAIN) & spaced if self.model else np.zeros(len(new), dtype=bool)
        if plain.any():
            places.append(np.flatnonzero(plain))
            flat, size = self._words(new.filter(pa.array(plain)))
            flats.append(flat)
            sizes.append(size)
            spaced &= ~plain
        for mask, join in ((spaced, ""), (bare, "\n")):
            rows = np.flatnonzero(mask)
            part = new.filter(pa.array(mask)).to_pylist()
            for i in range(0, len(part), TOGETHER):
                got = self._together(part[i:i + TOGETHER], join)
                if got is None:
                    mask[rows[i:i + TOGETHER]] = False
                else:
                    places.append(rows[i:i + TOGETHER])
                    flats.append(got[0])
                    sizes.append(got[1])
        odd = ~(plain | spaced | bare)
        if odd.any():
            got = [e.ids for e in self.tok.encode_batch_fast(new.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            places.append(np.flatnonzero(odd))
            flats.append(np.array([i for g in got for i in g], dtype=self.kind))
            sizes.append(np.array([len(g) for g in got], dtype=np.int64))
        if not places:
            return self.flat[:0], np.zeros(0, np.int64)
        order, size = np.argsort(np.concatenate(places)), np.concatenate(sizes)
        return gathered(np.concatenate(flats), offsets(size)[:-1][order], size[order]), size[order]

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and offsets; NULL is the empty text."""
        col = pc.fill_null(col.cast(pa.large_string()), "")
        start = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = col.buffers()[2] if start[-1] > start[0] else pa.py_buffer(b"")
        raw, start = np.frombuffer(data, dtype=np.uint8)[start[0]:start[-1]], start - start[0]
        begin = cuts(raw, start, self._special(col))
        if not len(begin):
            return np.zeros(0, self.kind), np.zeros(len(col) + 1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw))), pa.py_buffer(raw))
        coded = pa.chunked_array([self.names, pieces]).dictionary_encode().chunks[-1]  # one dictionary for both
        names, at = coded.dictionary, coded.indices.to_numpy()
        flat, size = self._learn(names[len(self.names):])
        flat, off = np.concatenate([self.flat, flat]), np.concatenate([self.off, self.off[-1] + np.cumsum(size)])
        many = np.diff(off)[at]
        out = np.concatenate([gathered(flat, off[at[i:i + GATHER]], many[i:i + GATHER]) for i in range(0, len(at), GATHER)])
        self._keep(names, flat, off, at)
        return out, offsets(many)[np.searchsorted(begin, start)]

    def _keep(self, names: pa.Array, flat: np.ndarray, off: np.ndarray, at: np.ndarray) -> None:
        """Hold the pieces that are not long; if they are too many, the half of the memo that was used last."""
        self.batch += 1
        used = np.concatenate([self.used, np.zeros(len(names) - len(self.used), np.int64)])
        used[at] = self.batch
        keep = pc.less_equal(pc.binary_length(names), LONG).to_numpy(zero_copy_only=False)
        if keep.sum() > MEMO:
            last = np.flatnonzero(keep)
            keep[last[np.argsort(-used[last], kind="stable")[MEMO // 2:]]] = False
        if not keep.all():
            size = np.diff(off)
            flat, off = flat[np.repeat(keep, size)], offsets(size[keep])
            names, used = names.filter(pa.array(keep)), used[keep]
        self.names, self.flat, self.off, self.used = names, flat, off, used


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids flat[start:start + size] of every piece in turn."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Encoder:
    """ids(texts) for a byte-level vocabulary (spaces belong to words) or a word vocabulary (white space is dropped)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), {}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        names = self.tok.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = self.tok.normalizer is None
        # The tokens that begin (spaced) or end a word, which tell words apart in a joined text.
        self.edge = np.zeros(size, dtype=bool)
        for name, i in names.items():
            self.edge[i] = name.startswith(SHOWN_SPACE) if self.spaced else name.endswith("</w>")
        self.pieces = Pieces(path, self.tok, self.kind, self.edge, self.special) if self.spaced else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in got]

    def _cut(self, text: str) -> str | None:
        """The pieces of a text, each followed by a space; None if it has to be encoded whole."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii() and (not unicodedata.is_normalized("NFC", text) or "Σ" in text or "İ" in text):
            return None
        if any(s in text for s in SEPARATORS):
            return None
        return "".join([w + " " for w in text.lower().split()])

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        memo, words, marked, odd = self.memo, set(), [], []
        for p in new:
            if p.isalpha() and (p.isascii() or max(p) < LATIN):
                words.add(p)
            elif p and p[-1] in MARKS and p[:-1].isalpha() and (p.isascii() or max(p) < LATIN):
                marked.append(p)
                if p[:-1] not in memo:
                    words.add(p[:-1])
            else:
                odd.append(p)
        out, rest = {}, list(words)
        for i in range(0, len(rest), JOINED):
            part = rest[i:i + JOINED]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(part):
                raise ValueError("words of a joined text cannot be told apart with this vocabulary")
            cut = np.concatenate([[0], at + 1]) * self.kind.itemsize
            raw = ids.tobytes()
            cut = cut.tolist()
            out.update(zip(part, [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        for i in range(0, len(odd), JOINED):
            part = odd[i:i + JOINED]
            out.update(zip(part, self._whole(part), strict=True))
        mark = {m: self._whole([m])[0] for m in {p[-1] for p in marked}}
        for p in marked:
            base = out.get(p[:-1])
            out[p] = (memo[p[:-1]] if base is None else base) + mark[p[-1]]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without special tokens, little-endian, `kind` wide."""
        if self.spaced:
            flat, off = self.pieces(pa.array(texts, pa.large_string()))
            raw, end = flat.tobytes(), (off * self.kind.itemsize).tolist()
            return [raw[x:y] for x, y in zip(end[:-1], end[1:], strict=True)]
        cut = [self._cut(t) for t in texts]
        names, at = distinct("".join([c for c in cut if c is not None]))
        got = list(map(self.memo.get, names))
        learnt = self._learn({p for p, g in zip(names, got, strict=True) if g is None})
        got = [learnt[p] if g is None else g for p, g in zip(names, got, strict=True)]
        width = self.kind.itemsize
        flat, off = np.frombuffer(b"".join(got), dtype=self.kind), offsets([len(g) // width for g in got])
        size = np.diff(off)[at]
        raw = b"".join([gathered(flat, off[at[i:i + GATHER]], size[i:i + GATHER]).tobytes() for i in range(0, len(at), GATHER)])
        ends = (offsets(size)[offsets([c.count(" ") for c in cut if c is not None])] * width).tolist()
        known = (raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
        whole = iter(self._whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        out = [next(whole) if c is None else next(known) for c in cut]
        if len(self.memo) + len(learnt) > MEMO:
            self.memo = {p: self.memo[p] for p in names if p in self.memo}
        for p in [p for p in learnt if len(p) > LONG]:
            del learnt[p]
        self.memo.update(learnt)
        return out

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, flat, and offsets; NULL is the empty text."""
        if self.spaced:
            return self.pieces(col)
        got = self.ids([t or "" for t in col.to_pylist()])
        return np.frombuffer(b"".join(got), dtype=self.kind), offsets([len(g) // self.kind.itemsize for g in got])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path)
