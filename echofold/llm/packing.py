"""Hierarchical multi-length packing of token sequences.

Every task packs what it reads, in units of bounded size, without any exchange.
A document of n ids (its end id included) gives full windows of the largest tier
and a rest, routed to the smallest tier that holds it. Tiers are packed from the
longest: a rest opens a window of its tier, and the gap is filled with rests of
shorter tiers, the largest that fit first; only where none fits is one cut to
close the window. So a window is full, of 4096 ids or of a smaller power of two,
and what cannot be filled waits for the next unit. The last unit of a task
closes its rest in smaller and smaller tiers; less than the smallest tier is padded.

Windows of a unit are dealt to step groups of about `STEP` ids each, the longest
first and always to the lightest group, so that steps weigh the same.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import slices, small_batches, texts
from echofold.llm.encode import encoder
from echofold.llm.registry import query, table

TIERS = (512, 1024, 2048, 4096)
#: Ids that one unit of packing holds, about, and ids of a step.
UNIT = 1 << 21
STEP = 1 << 18


class Packer:
    """Packs rests (length, key) in units; `key` says where the ids are, first and how many follow from the cuts."""

    def __init__(self, tiers=TIERS, step: int = STEP):
        self.tiers, self.step = tuple(sorted(tiers)), step
        self.rests: list[tuple[int, int, int]] = []     # (length, document, first id), sorted
        self.windows: list[tuple[int, list]] = []       # (tier, [(document, first, length)])

    def add(self, doc: int, n: int) -> None:
        top = self.tiers[-1]
        for s in range(0, n - n % top, top):
            self.windows.append((top, [(doc, s, top)]))
        if n % top:
            self.rests.append((n % top, doc, n - n % top))

    def _fill(self, gap: int) -> list | None:
        """Rests that close a gap, the largest that fit first, at most the last one cut; None if there are too few."""
        taken, left = [], gap
        while left and self.rests:
            i = bisect_right(self.rests, (left, 1 << 62, 0)) - 1
            if i >= 0:
                n, doc, first = self.rests.pop(i)
                taken.append((doc, first, n))
                left -= n
            else:
                n, doc, first = self.rests.pop(0)
                taken.append((doc, first, left))
                rest = (n - left, doc, first + left)
                self.rests.insert(bisect_right(self.rests, rest), rest)
                left = 0
        if left:
            self.rests += [(n, doc, first) for doc, first, n in taken]
            self.rests.sort()
            return None
        return taken

    def pack(self) -> None:
        """Close every window that can be filled, tier by tier from the longest."""
        self.rests.sort()
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, under = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.rests and self.rests[-1][0] > under:
                n, doc, first = self.rests.pop()
                filled = self._fill(tier - n)
                if filled is None:
                    self.rests.append((n, doc, first))
                    return  # all rests together do not fill it: they wait
                self.windows.append((tier, [(doc, first, n), *filled]))

    def finish(self) -> None:
        """Close what is left in tiers of falling size; the remainder is one short window."""
        for tier in reversed(self.tiers):
            while sum(r[0] for r in self.rests) >= tier:
                self.windows.append((tier, self._fill(tier)))
        if self.rests:
            self.windows.append((self.tiers[-1], [(doc, first, n) for n, doc, first in self.rests]))
            self.rests = []

    def take(self) -> list[tuple[int, int, list]]:
        """The closed windows as (step group, tier, pieces)."""
        sizes = [sum(p[2] for p in w[1]) for w in self.windows]
        groups = [(0, g) for g in range(max(1, round(sum(sizes) / self.step)))]
        out = [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, g = heapq.heappop(groups)
            heapq.heappush(groups, (load + sizes[i], g))
            out[i] = (g, *self.windows[i])
        self.windows = []
        return out


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, unit: int = UNIT, step: int = STEP,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and ids if asked for.

    Every row of `docs` is a document of its own, whatever its id; a NULL or empty
    text is its end id alone. Sequences and groups are numbered within their
    task, whose number is in the upper half of the id.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc, task = encoder(vocabulary), TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype=enc.kind).tobytes()
        width = enc.kind.itemsize
        packer, held, number, group, weight, seen = Packer(tiers, step), {}, 0, 0, 0, 0

        def rows():
            nonlocal number, group
            out = []
            last = 0
            for g, tier, parts in packer.take():
                at = 0
                for doc, first, n in parts:
                    doc_id, raw = held[doc]
                    ids = np.frombuffer(raw, dtype=enc.kind, count=n, offset=first * width).astype("<u4")
                    row = [doc_id, first, n, zlib.crc32(ids.tobytes()), len(raw) // width, task + number, at, tier, task + group + g]
                    out.append([*row, ids.astype(np.int32).tolist()] if with_ids else row)
                    at += n
                number += 1
                last = max(last, g + 1)
            group += last
            keep = {doc for _, doc, _ in packer.rests}
            for doc in [d for d in held if d not in keep]:
                del held[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), *[(f.split()[0], pa.int32() if f.split()[1] == "int" else pa.int64()) for f in FIELDS.split(", ")],
                                *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
            names, text = b.column(0).to_pylist(), texts(b)
            for i, j in slices([len(t) for t in text], 2_000_000):
                for doc_id, raw in zip(names[i:j], enc.ids(text[i:j]), strict=True):
                    held[seen] = (doc_id, raw + end)
                    packer.add(seen, len(raw) // width + 1)
                    seen, weight = seen + 1, weight + len(raw) // width + 1
                if weight >= unit:
                    packer.pack()
                    weight = 0
                    if packer.windows:
                        yield rows()
        if seen:
            packer.pack()
            packer.finish()
            if packer.windows:
                yield rows()

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}{more}")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
