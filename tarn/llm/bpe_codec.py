"""BPE encoding and decoding (operator 3), by tree concatenation.

See :class:`tarn.llm.bpe.WordEndCodec` for the method and why its joins are
exact. One narrow pass over the documents; nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.bpe import LEAF_CHARS, LEAF_WORD, word_end_codec
from tarn.llm.common import document_columns, emit, pairs


def encode(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    leaf_chars: int = LEAF_CHARS,
    leaf_word: int = LEAF_WORD,
) -> DataFrame:
    """Token ids of every whole text, and with ``decoded`` their decoded text.

    Returns ``doc_id, ids`` (binary: little-endian unsigned 32-bit integers)
    and, if asked for, ``decoded``, one row per input row. A null text encodes
    as an empty one; whole texts are encoded, however long, in leaves of
    ``leaf_chars`` characters and ``leaf_word`` of a word, which change no result;
    repeated rows stay repeated; a null id stays null; an empty table gives an empty
    result. Extra columns are ignored, whatever their names.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.binary())]
    if decoded:
        fields.append(pa.field("decoded", pa.string()))
    schema = pa.schema(fields)

    def run(batches):
        codec = word_end_codec(vocabulary, leaf_chars, leaf_word)

        def rows():
            for batch in batches:
                for doc_id, text in pairs(batch):
                    ids = codec.encode(text)
                    yield (doc_id, ids, codec.decode(ids)) if decoded else (doc_id, ids)

        yield from emit(rows(), schema, lambda r: 64 + sum(map(len, r[1:])))

    out = "doc_id long, ids binary" + (", decoded string" if decoded else "")
    return document_columns(docs, id_col, text_col).mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of packed ids, tokens joined by one space (null: empty).

    Repeated rows stay repeated; extra columns are ignored; an empty table gives an
    empty result.
    """
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("decoded", pa.string())])

    def run(batches):
        codec = word_end_codec(vocabulary)
        rows = ((i, codec.decode(x or b"")) for batch in batches for i, x in pairs(batch))
        yield from emit(rows, schema, lambda r: 64 + len(r[1]))

    return document_columns(encoded, id_col, ids_col).mapInArrow(run, "doc_id long, decoded string")
