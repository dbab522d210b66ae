"""Token counts: the pieces of a subword tokenizer, counted once per distinct pre-token.

``token_counts`` splits each text where no piece of the vocabulary can span, counts pieces once per distinct
pre-token of the whole corpus, and sums the counts by document. No token ids of documents are ever made.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; a null
doc_id is kept; other columns of the input, whatever their names, are ignored; an empty table gives no rows;
texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, keyed
from ._text import flat, pieces, segment_sum


@cache
def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def check_vocabulary(model: str) -> bool:
    """Whether no piece has a word mark after another character, nor a newline: then the splits of
    ``_pretokens`` cannot change the pieces. Raises for a vocabulary that the splits don't suit."""
    sp = _processor(model)
    mark = "▁"
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and (mark in p.lstrip(mark) or "\n" in p):
            raise ValueError(f"piece {p!r} spans a pre-token boundary")
    if sp.encode("a\n b") != [*sp.encode("a"), *sp.encode("\n")[1:], *sp.encode("b")]:
        raise ValueError("the model's normaliser doesn't keep newlines and single spaces")
    return True


def _pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pre-tokens, the index of the first one of each document (n + 1 values), and the documents' bytes.

    A pre-token starts at a document's start, at a newline, after a newline, and at a space after a byte
    that is neither a space nor the end of a literal word mark. The tokenizer's leading space is put in front.
    """
    _, offs = flat(texts)
    size = np.diff(offs)
    texts = texts if not texts.null_count else pc.fill_null(texts, "")
    data, offs = flat(pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), pa.scalar("", texts.type)))
    if not len(data):
        z = np.zeros(len(offs), np.int64)
        return pa.array([], pa.large_binary()), z, size
    space, line = data == 32, data == 10
    mark = np.zeros(len(data), bool)
    mark[2:] = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
    start = line.copy()
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1] & ~mark[:-1])
    start[offs[:-1][size > 0]] = True
    at = np.flatnonzero(start)
    bounds = np.append(at, len(data)).astype(np.int64)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return arr, np.searchsorted(at, offs), size


def _count_pieces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            for b in pieces(batch, "key"):
                # A newline in front keeps the model's leading space off the pre-token; it costs two pieces.
                ids = sp.encode(["\n" + k.decode("utf-8", "replace") for k in b.column("key").to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.binary()), b.column("freq"), pa.array([len(x) - 2 for x in ids], pa.int64())], ["key", "freq", "pieces"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row; over_limit: n_tokens > limit.

    model: path of a sentencepiece model that every executor can read.
    """
    check_vocabulary(model)
    spark, scratch = docs.sparkSession, _spark.Scratch(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys_of(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        for b in pieces(batch, "text", 4 << 20):
            yield _pretokens(b.column("text"))[0]

    counted = keyed.count_keys(docs, ["text"], keys_of)
    table = scratch.cut(counted.mapInArrow(_count_pieces(model), "key binary, freq long, pieces long"), "pieces")
    head = spark.sparkContext.broadcast(keyed.head_of(table, ["pieces"]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = head.value
        keys, worth = t["key"].combine_chunks().cast(pa.large_binary()), np.append(t["pieces"].to_numpy(), -1)
        for batch in batches:
            for b in pieces(batch, "text", 4 << 20):
                tokens, first, size = _pretokens(b.column("text"))
                n = len(b)
                code = tokens.dictionary_encode()
                at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                known = pc.fill_null(pc.index_in(code.dictionary, keys), len(keys)).to_numpy(zero_copy_only=False)
                value = worth[known][at] if len(at) else np.zeros(0, np.int64)
                base = segment_sum(np.maximum(value, 0), first)
                doc = np.repeat(np.arange(n), np.diff(first))
                rare = value < 0
                pair, times = np.unique(doc[rare] * max(1, len(code.dictionary)) + at[rare], return_counts=True)
                d, k = pair // max(1, len(code.dictionary)), pair % max(1, len(code.dictionary))
                lead = np.ones(len(d), bool)
                lead[1:] = d[1:] != d[:-1]
                # Documents without rare pre-tokens get one row whose key, not UTF-8, matches nothing and is spread over the partitions.
                none = np.flatnonzero(np.bincount(d, minlength=n) == 0)
                rows = np.concatenate((d, none))
                front = np.concatenate((lead, np.ones(len(none), bool)))
                alone = pa.array([b"\xff" + int(r).to_bytes(8, "big", signed=True) for r in b.column("row").to_numpy()[none]], pa.large_binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row").take(pa.array(rows)),
                        b.column("id").take(pa.array(rows)),
                        pa.array(np.where(front, size[rows], 0), pa.int64()),
                        pa.array(np.where(front, base[rows], 0), pa.int64()),
                        pa.concat_arrays([code.dictionary.take(pa.array(k)), alone]).cast(pa.binary()),
                        pa.array(np.concatenate((times, np.zeros(len(none), np.int64))), pa.int64()),
                    ],
                    ["row", "id", "n_bytes", "base", "key", "times"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(summed, f"row long, id {kind}, n_bytes long, base long, key binary, times long")
    return (
        rows.join(table.select("key", "pieces"), "key", "left")
        .groupBy("row", "id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
