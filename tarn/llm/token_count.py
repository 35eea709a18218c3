"""Token counts (operator 5): heap-and-linked-list byte-pair merging.

See :class:`tarn.llm.bpe.ByteLevelCounter`. No identifiers are made: the count
of a piece is its first symbols less its merges. One narrow pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.bpe import byte_level_counter
from tarn.llm.common import document_columns, emit, pairs


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, one row per input row.

    Special strings inside texts count as one token each. Null and empty texts
    have no bytes and no tokens; whole texts are counted, however long; repeated rows
    stay repeated; a null id stays null; extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_bytes", "n_tokens")])

    def run(batches):
        counter = byte_level_counter(vocabulary)
        rows = (
            (i, len(x.encode()) if x else 0, counter.count(x)) for batch in batches for i, x in pairs(batch)
        )
        yield from emit(rows, schema)

    return document_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
