"""Byte-level BPE for whole corpora: text cut where pre-tokens cannot cross, and ranks merged in lockstep.

Cutting: between a white-space character and what follows, or before a run of
white space, a pre-token of the public pattern always ends. So a text may be
cut before every single space or newline whose neighbours are not both white
space, and each piece has its tokens on its own. Pieces repeat, and a bounded
memo holds what they came to.

Counting: pieces that are new are split into pre-tokens, their bytes laid out
as one ragged array of symbols, and in each round every sequence applies its
own lowest-ranked pair at all its places at once. A merged symbol only occurs
in pairs of higher rank than the one that made it, so this takes the merges in
the same order as the library does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from echofold.llm.common import offsets, segment_sums

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: A space or newline with white space on both sides: no safe cut there.
TANGLED = re.compile(r"\s[ \n](?:\s|\Z)")
#: Pieces that the memo holds, longest of them, and pre-tokens of one ragged batch.
MEMO = 800_000
LONG = 64
RAGGED = 4_000
#: End of the letters that every Unicode version has alike.
LATIN = "\u0250"
#: Marks of one byte that make a pre-token of their own between a letter and white space.
MARKS = (",", ".", "!", "?", ";", ":")
SLOT_BITS = 20
#: Marks the piece that begins a text, which has no space before it; a text that holds it is not cut.
FIRST = "\0"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file: visible Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def parted(text: str) -> str | None:
    """A text with its pieces, whose tokens do not depend on each other, parted by single spaces; None if it cannot be cut this way."""
    if TANGLED.search(text) or " \n" in text:
        return None
    return text.replace("\n", " \n")


def pieces(text: str) -> list[str] | None:
    """The pieces of a text, or None if it cannot be cut.

    A piece that follows a space is given without it, one that follows nothing starts with its own
    first character; so a piece starting with a newline is as it stands.
    """
    got = parted(text)
    return None if got is None else got.split(" ")


class Ranks:
    """The merge table of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, alphabet = model["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.of_byte = np.zeros(256, dtype=np.int64)
        for ch, b in alphabet.items():
            self.of_byte[b] = vocab[ch]
        left, right, made = [], [], []
        for m in model["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        key = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        self.made, self.none = np.array(made, dtype=np.int64), len(key)
        # Open addressing at a load of a twentieth: slot -> rank, -1 where empty.
        self.keys, self.slots = key, np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left_over = self.slots[at] != todo
            todo, at = todo[left_over], (at[left_over] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, `none` where there is no such merge."""
        want = a << 32 | b
        at = self._slot(want)
        got = self.slots[at]
        odd = np.flatnonzero((got >= 0) & (self.keys[got] != want))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.slots) - 1)
            got[odd] = self.slots[at[odd]]
            odd = odd[(got[odd] >= 0) & (self.keys[got[odd]] != want[odd])]
        return np.where(got < 0, self.none, got)

    def merged(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pre-tokens after every merge, flat, and the number each keeps."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        done_sym, done_seq = [], []
        rank = np.full(len(sym), self.none, dtype=np.int64)
        at = np.flatnonzero(seq[1:] == seq[:-1])
        rank[at] = self.pair_ranks(sym[at], sym[at + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            length = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            live = best < self.none
            if not live.all():
                done_sym.append(sym[~live])
                done_seq.append(seq[~live])
                sym, seq, rank, best = sym[live], seq[live], rank[live], best[live]
                if not len(sym):
                    break
            hit = rank == best
            # Overlapping places of a pair, as in aaa: every other one of a run, from the left.
            run = np.flatnonzero(hit[1:] & hit[:-1] & (seq[1:] == seq[:-1])) + 1
            if len(run):
                follows = np.zeros(len(sym), dtype=bool)
                follows[run] = True
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(sym))))
                hit &= (np.arange(len(sym)) - start) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            stale = np.zeros(len(sym), dtype=bool)
            stale[where] = True
            stale, sym, seq, rank = stale[keep], sym[keep], seq[keep], rank[keep]
            stale[:-1] |= stale[1:] & (seq[1:] == seq[:-1])
            rank[stale] = self.none
            at = np.flatnonzero(stale[:-1] & (seq[1:] == seq[:-1]))
            rank[at] = self.pair_ranks(sym[at], sym[at + 1])
        done_sym.append(sym)
        done_seq.append(seq)
        sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(tokens))


class Counter:
    """Token counts of texts, by `Ranks.merged` and a bounded memo of pieces."""

    def __init__(self, path: str):
        self.ranks, self.memo = Ranks(path), {}
        names = sorted(self.ranks.special, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, names))) if names else None

    def _learn(self, new: set[str]) -> dict[str, int]:
        """Counts of pieces (keys as in `pieces`), all merged in ragged batches.

        A plain word is one pre-token; a mark after it is one more of one byte, so the word is looked up on its own.
        """
        memo, words, marked, odd = self.memo, set(), [], []
        for p in new:
            if p.isalpha() and max(p) < LATIN:
                words.add(p)
            elif p and p[-1] in MARKS and p[:-1].isalpha() and max(p) < LATIN:
                marked.append(p)
                if p[:-1] not in memo:
                    words.add(p[:-1])
            else:
                odd.append(p)
        out = {}
        rest = list(words)
        for i in range(0, len(rest), RAGGED):
            part = rest[i:i + RAGGED]
            out.update(zip(part, self.ranks.merged([b" " + p.encode() for p in part])[1].tolist(), strict=True))
        for i in range(0, len(odd), RAGGED):
            part = odd[i:i + RAGGED]
            found = [PATTERN.findall(p if p[:1] == "\n" else p[1:] if p[:1] == FIRST else " " + p) if p else [" "] for p in part]
            n = self.ranks.merged([t.encode() for f in found for t in f])[1]
            out.update(zip(part, segment_sums(n, offsets([len(f) for f in found])).tolist(), strict=True))
        for p in marked:
            n = out.get(p[:-1])
            out[p] = (memo[p[:-1]] if n is None else n) + 1
        return out

    def _plain(self, text: str) -> int:
        raw = [t.encode() for t in PATTERN.findall(text)]
        return int(self.ranks.merged(raw)[1].sum()) if raw else 0

    def __call__(self, batch: list[str]) -> list[int]:
        cut: list[list[str]] = []
        extra = [0] * len(batch)
        for k, text in enumerate(batch):
            parts = [text]
            if self.split and self.split.search(text):
                parts = self.split.split(text)
                extra[k] += len(parts) - 1
            mine: list[str] = []
            for p in parts:
                got = pieces(p) if p and FIRST not in p else None
                if got is None:
                    extra[k] += self._plain(p)
                    continue
                if got[0] and got[0][0] != "\n":
                    got[0] = FIRST + got[0]
                mine += got if got[0] else got[1:]
            cut.append(mine)
        every = set().union(*cut)
        learnt = self._learn(every.difference(self.memo))
        if len(self.memo) + len(learnt) > MEMO:
            self.memo = {p: self.memo[p] for p in every if p in self.memo}
        self.memo.update(learnt)
        look = self.memo.__getitem__
        out = [extra[k] + sum(map(look, c)) for k, c in enumerate(cut)]
        for p in [p for p in learnt if len(p) > LONG]:
            del self.memo[p]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each vocabulary in a worker process, so that its memo lasts from task to task."""
    return Counter(path)
