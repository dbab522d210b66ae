"""SentencePiece encoding and decoding: each distinct marked word is segmented once, its ids join back by position.

Where no piece of a vocabulary spans a word mark or a newline, a text's ids are those of its chunks (``token_counts``
has where chunks start), one after another. So the distinct chunks of the corpus are counted and segmented once, into a
table. Documents then hold places in that table instead of chunks: the most frequent ones, at most ``HEAD_KEYS`` of at
most ``HEAD_BYTES`` bytes, are broadcast and found where a document is read; the rest join the table by chunk, each with
its positions in the document, and meet their document again by row number. A document is read from the input, never
shuffled: what moves are its places in the head, one plane of bytes after another, compressed.

Frequent chunks never reach a shuffle, so its keys are rare ones, or long ones, which adaptive execution splits. What
one task holds of a document is its own ids and rare chunks.

Defined cases: null and empty texts have the end id only; repeated rows give repeated results; a null id is kept; other
columns of the input, whatever their names, are ignored; an empty table gives no rows; texts of any length are encoded
whole. Special strings in a text are ordinary text, as the library takes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks, _spark, keyed
from ._text import flat, pieces
from .token_counts import _pretokens, _processor, check_vocabulary

#: Bound of the chunks that are broadcast, with their ids: 48 MB of chunks at most.
HEAD_KEYS, HEAD_BYTES = 1 << 20, 48
#: Bytes of text (pieces, so many at once), of chunks to segment and of packed documents, and rows to decode, that are worked on at a time.
TEXT_BYTES, AT_ONCE, KEY_BYTES, PACKED_BYTES, ROWS = 1 << 20, 16, 1 << 19, 1 << 19, 512


def _width(model: str) -> int:
    """16-bit numbers that an id takes."""
    return 1 if _processor(model).get_piece_size() <= 1 << 16 else 2


def segments(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(key, freq, ids): every distinct chunk of the texts, how often it is there, and its ids, ``_width`` 16-bit numbers each."""
    width = _width(model)

    def keys_of(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        for b in pieces(batch, text_col, TEXT_BYTES):
            yield _pretokens(b.column(text_col))[0]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            for b in pieces(batch, "key", KEY_BYTES):
                # A newline in front, two pieces, keeps the model's leading space off the chunk.
                found = sp.encode(["\n" + k.decode("utf-8", "replace") for k in b.column("key").to_pylist()], num_threads=1)
                ids = pa.array([np.array(x[2:], np.uint16 if width == 1 else np.int32).tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.binary()), b.column("freq"), ids], ["key", "freq", "ids"])

    return keyed.count_packed(docs, [text_col], keys_of, segment, "key binary, freq long, ids binary")


def _places(batch: pa.RecordBatch, head: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """Pieces of the batch: each with its chunks as a dictionary array, the head's place of each chunk (-1: none), and each document's first chunk.

    The head is searched once for the distinct chunks of several pieces.
    """
    todo = list(pieces(batch, "text", TEXT_BYTES))
    for k in range(0, len(todo), AT_ONCE):
        some = todo[k : k + AT_ONCE]
        found = [_pretokens(b.column("text")) for b in some]
        codes = [f[0].dictionary_encode() for f in found]
        firsts = [f[1] for f in found]
        del found
        known = pc.fill_null(pc.index_in(pa.concat_arrays([c.dictionary for c in codes]), head), -1).to_numpy(zero_copy_only=False)
        at = 0
        for b, code, first in zip(some, codes, firsts, strict=True):
            own = known[at : at + len(code.dictionary)]
            at += len(code.dictionary)
            yield b, code, own[code.indices.to_numpy(zero_copy_only=False)] if len(code) else np.zeros(0, np.int32), first


def _rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as a binary column; bounds: where they begin, and the end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())]).cast(pa.binary())


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit numbers of a binary column, and where each row's begin (and the end)."""
    data, offs = flat(column)
    return np.ascontiguousarray(data).view(np.uint16), offs // 2


def _at(units: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """The numbers of ``width`` units that begin at place."""
    low = units[place].astype(np.int32)
    return low if width == 1 else low | units[place + 1].astype(np.int32) << 16


def _runs(count: np.ndarray) -> np.ndarray:
    """0 to count[0] - 1, 0 to count[1] - 1, ..."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _packed(places: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed: the upper planes are nearly empty."""
    return pa.compress((places + 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(places) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64) - 1


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, decoded: bool = False) -> DataFrame:
    """(id_col, ids): the library's ids of each whole text, with the end id last if ``end``; and what they ``decode`` to, in the same pass, if ``decoded``.

    model: path of a sentencepiece model that every executor can read.
    """
    check_vocabulary(model)
    scratch = _spark.Scratch(docs.sparkSession)
    docs = _spark.with_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch)
    table = scratch.cut(segments(docs, model), "segments", free=True)
    short = F.octet_length("key") <= HEAD_BYTES
    in_head = short & (F.col("freq") >= F.lit(_spark.head_cut(table.where(short), "freq", HEAD_KEYS)))
    head = table.where(in_head).orderBy(F.desc("freq"), "key").select("key", "ids").toArrow().combine_chunks()
    head = pa.table({"key": head["key"].cast(pa.large_binary()), "ids": head["ids"]}).combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(head)
    last = [_processor(model).eos_id()] if end else []

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value["key"].combine_chunks()
        for batch in batches:
            for b, _, at, first in _places(batch, keys):
                packed = pa.array([_packed(at[f:t]) for f, t in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(np.diff(first), pa.int64()), packed], ["row", "id", "n", "data"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value["key"].combine_chunks()
        for batch in batches:
            for b, code, at, first in _places(batch, keys):
                lost = np.flatnonzero(at < 0)
                if not len(lost):
                    continue
                doc = np.searchsorted(first, lost, "right") - 1
                word = code.indices.to_numpy(zero_copy_only=False)[lost].astype(np.int64)
                pair = doc * len(code.dictionary) + word
                order = np.argsort(pair, kind="stable")
                begin = np.flatnonzero(np.diff(pair[order], prepend=-1))
                lead = order[begin]
                spots = _rows((lost - first[doc])[order], np.append(begin, len(lost)))
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(doc[lead])), code.dictionary.take(pa.array(word[lead])).cast(pa.binary()), spots], ["row", "key", "spots"])

    kind = docs.schema["id"].dataType.simpleString()
    # Of a document: its number of chunks, and their places in the head. Of a rare chunk in it: less than no chunks, its spots and ids.
    found = docs.select("row", "text").mapInArrow(rare, "row long, key binary, spots binary").join(table.where(~in_head).select("key", "ids"), "key")
    found = found.select("row", (-F.octet_length("spots") / 4).cast("long").alias("n"), F.concat("spots", "ids").alias("data"))
    # Written before documents' places are shuffled, so that the join's shuffles and the table take no disk beside them.
    found = scratch.cut(found, "found", free=True).select("row", F.lit(None).cast(kind).alias("id"), "n", "data")
    scratch.drop("segments")
    both = docs.mapInArrow(known, f"row long, id {kind}, n long, data binary").unionByName(found)
    width = _width(model)

    def assembled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The ids of whole documents; a document's own row comes first, its rare chunks after it."""
        b = t.combine_chunks().to_batches()[0]
        n = b.column("n").to_numpy()
        docs = np.flatnonzero(n >= 0)
        chunks, doc = n[docs], np.cumsum(n >= 0) - 1
        base = np.cumsum(chunks) - chunks  # each document's first chunk
        packed = b.column("data").take(pa.array(docs)).to_pylist()
        places = np.concatenate([_unpacked(x, k) for x, k in zip(packed, chunks.tolist(), strict=True)])
        head_units, head_at = _units(shared.value["ids"].combine_chunks())
        # Rare chunks: every spot of a row of theirs takes that row's ids.
        other = np.flatnonzero(n < 0)
        units, at = _units(b.column("data").take(pa.array(other)))
        times = -n[other]
        of = np.repeat(np.arange(len(other)), times)
        place = base[doc[other]][of] + _at(units, at[:-1][of] + 2 * _runs(times), 2)
        source = np.where(places >= 0, places, 0)
        source[place] = of
        common = np.ones(len(places), bool)
        common[place] = False
        size = np.zeros(len(places), np.int64)
        kinds = ((common, head_units, head_at[:-1], np.diff(head_at) // width), (~common, units, at[:-1] + 2 * times, (np.diff(at) - 2 * times) // width))
        for own, _, _, count in kinds:
            size[own] = count[source[own]]
        # Where each chunk begins: after the chunks before it, and the end ids of the documents before its own.
        of_doc = np.repeat(np.arange(len(docs)), chunks)
        start = np.cumsum(size) - size + len(last) * of_doc
        length = np.bincount(of_doc, weights=size, minlength=len(docs)).astype(np.int64) + len(last)
        out = np.full(int(length.sum()), last[0] if last else 0, np.int32)
        for own, numbers, begin, _ in kinds:
            k = size[own]
            step = _runs(k)
            out[np.repeat(start[own], k) + step] = _at(numbers, np.repeat(begin[source[own]], k) + width * step, width)
        bounds = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32))
        columns = {"id": b.column("id").take(pa.array(docs)), "ids": pa.ListArray.from_arrays(bounds, pa.array(out))}
        if decoded:
            columns["decoded"] = _texts(_processor(model), columns["ids"])
        yield pa.RecordBatch.from_pydict(columns)

    return _blocks.grouped(both, "row", assembled, f"id {kind}, ids array<int>{', decoded string' if decoded else ''}", 20_000, PACKED_BYTES, then=(F.col("n").desc(),)).withColumnRenamed("id", id_col)


def _texts(sp, column: pa.ListArray) -> pa.Array:
    """What the library decodes each array of ids to; null arrays are empty."""
    ids = column.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
    return pa.array([sp.decode(ids[f:t].tolist()) if t > f else "" for f, t in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """encoded with the text that the library's decode gives for each array of ids, in the column ``to_col``; null arrays are empty."""
    schema = encoded.withColumn(to_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns, _texts(_processor(model), b.column(ids_col))], [*b.schema.names, to_col])

    return encoded.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of the ids, in decimals joined by spaces, and of the text they decode to."""
    both = encode(docs, model, id_col, text_col, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
