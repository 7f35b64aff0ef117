"""Token counts of whole texts by rank-synchronous merging."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.bpe import counter
from echofold.llm.common import slices, small_batches, texts
from echofold.llm.registry import query, table

#: Characters that one ragged batch of a task holds.
CHARS = 2_000_000


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of each text: (doc_id, n_bytes, n_tokens, over_limit).

    One row out for each row in, so repeated rows and NULL ids stay as they are;
    a NULL or empty text has no bytes and no tokens. `vocabulary` is the path of
    a byte-level BPE file, the same on every machine. No exchange; a task
    holds one Arrow batch and a memo of bounded size.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(vocabulary)
        for b in batches:
            text, n = texts(b), []
            for i, j in slices([len(t) for t in text], CHARS):
                n += count(text[i:j])
            size = pa.array([len(t.encode()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
