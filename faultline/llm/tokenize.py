"""Problem 6: the whole corpus encoded with a public byte-level BPE, by merge replay over a corpus-level inverted index.

Documents are cut into the vocabulary's word pieces once. A block (a few thousand documents) keeps its documents as
references into its own dictionary of distinct pieces. The dictionaries of all blocks are brought together by piece, so that a
piece is in one partition of the index, whatever number of documents holds it, and is encoded once for the corpus. There
an inverted index maps every pair of neighbouring tokens to the places where it stands in the partition's
pieces; a heap yields the pairs in rank order; each merge is applied to all its places at once and
touches only the neighbours of those places. Merges never cross pieces, so the partitions of the index do not
depend on each other. The ids go back to the blocks that asked for them, one row per block and distinct piece; a piece that stands
everywhere has a row per block, not per occurrence.

The vocabulary is read on the driver and shipped with the job.

Defined results: a null text and an empty text give an empty list; the spelling of a special token in a
text is ordinary text; lone surrogates cannot occur in a Spark string. A piece of any length is
encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.session import shuffle_partitions, spread, written

#: Public pre-tokenisation pattern of this family of vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a block of documents, and bytes of pieces in one part of the index.
BLOCK_CHARS = 4_000_000
INDEX_BYTES = 8_000_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_TABLES: dict[bytes, MergeTable] = {}


def merge_table(data: bytes) -> MergeTable:
    """One table per worker process and vocabulary."""
    key = data[:64] + len(data).to_bytes(8)
    if key not in _TABLES:
        _TABLES[key] = MergeTable(load_ranks(data))
    return _TABLES[key]


class MergeTable:
    """Which two token ids merge into which; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._merged: dict[tuple[int, int], int | None] = {}

    def merged(self, pair: tuple[int, int]) -> int | None:
        known = self._merged
        if pair not in known:
            if len(known) > 2_000_000:
                known.clear()
            known[pair] = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        return known[pair]


def replay(pieces: list[bytes], table: MergeTable) -> list[list[int]]:
    """Token ids of each piece. All pieces lie in one array with gaps between them; `after` and `before` link the
    live tokens of a piece; `places` is the inverted index from a pair to the left ends where it stands."""
    ids: list[int] = []
    starts: list[int] = []
    byte_ids = table.byte_ids
    for p in pieces:
        starts.append(len(ids))
        ids.extend(byte_ids[b] for b in p)
        ids.append(-1)
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    heap: list[tuple[int, tuple[int, int]]] = []

    def note(pair: tuple[int, int], at: int) -> None:
        known = places.get(pair)
        if known is not None:
            known.append(at)
        elif (rank := table.merged(pair)) is not None:
            places[pair] = [at]
            heapq.heappush(heap, (rank, pair))

    for i in range(n - 1):
        if ids[i] >= 0 and ids[i + 1] >= 0:
            note((ids[i], ids[i + 1]), i)
    while heap:
        rank, pair = heapq.heappop(heap)
        left, right = pair
        spots = places.pop(pair)
        spots.sort()
        for i in spots:
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # an earlier merge took one of the two
            ids[i], ids[j] = rank, -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if ids[k] >= 0:
                    note((rank, ids[k]), i)
            h = before[i]
            if h >= 0 and ids[h] >= 0:
                note((ids[h], rank), h)
    out = []
    for p, start in zip(pieces, starts):
        end, own, i = start + len(p), [], start
        while i < end:
            own.append(ids[i])
            i = after[i]
        out.append(own)
    return out


def vocabulary(folder: str, tokenizer: str) -> bytes:
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        return f.read()


def _cut(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[pa.RecordBatch]:
    """Documents as references into their block's dictionary, and the dictionary (rows without references)."""
    from pyspark import TaskContext

    split = regex.compile(PATTERN).findall
    block = TaskContext.get().partitionId() << 32
    for b in batches:
        for part in _blocks(b, block_chars):
            index: defaultdict[str, int] = defaultdict()
            index.default_factory = index.__len__
            look = index.__getitem__
            refs = [array("I", map(look, split(t))).tobytes() if t else b"" for t in part.column(1).to_pylist()]
            n, m = part.num_rows, len(index)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), part.column(0), pa.array(refs, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], _CUT)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.nulls(m, part.column(0).type), pa.nulls(m, pa.binary()), pa.array(list(index), pa.string()), pa.array(np.arange(m, dtype=np.int32))], _CUT)
            block += 1


_CUT = ["block", "doc_id", "refs", "piece", "at"]


def _blocks(b: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > chars:
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield b.slice(start)


def _replayed(batches: Iterator[pa.RecordBatch], table: MergeTable, index_bytes: int, count_only: bool) -> Iterator[pa.RecordBatch]:
    """(block, at, ids) of dictionary rows in order of their pieces: every distinct piece is replayed once."""
    held: list[tuple[int, int, int]] = []
    pieces: list[bytes] = []
    last, size = None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids = [array("i", x).tobytes() for x in replay(pieces, table)]
        if count_only:
            ids = [array("i", (len(x) // 4,)).tobytes() for x in ids]
        block, at, piece = zip(*held)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(at, pa.int32()), pa.array([ids[i] for i in piece], pa.binary())], ["block", "at", "ids"])

    for b in batches:
        for block, at, piece in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("piece").to_pylist()):
            if piece != last:
                if size > index_bytes:
                    yield from flush()
                    held, pieces, size = [], [], 0
                pieces.append(piece.encode())
                last, size = piece, size + len(piece) + 16
            held.append((block, at, len(pieces) - 1))
            if len(held) > 500_000:  # one piece of very many blocks
                yield from flush()
                held, pieces, size = [], [pieces[-1]], 0
    if held:
        yield from flush()


def _ragged(refs: list[bytes], words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all documents' pieces in a row, offsets of the documents among them)."""
    at = words.column("at").to_numpy()
    blobs = words.column("ids").combine_chunks().cast(pa.large_binary())
    if isinstance(blobs, pa.ChunkedArray):
        blobs = pa.concat_arrays(blobs.chunks) if blobs.num_chunks else pa.array([], pa.large_binary())
    bounds = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1] // 4
    values = np.frombuffer(blobs.buffers()[2] or b"", np.int32)
    row_of = np.empty(len(at), np.int64)
    row_of[at] = np.arange(len(at))
    asked = row_of[np.frombuffer(b"".join(refs), np.uint32)]
    length = (bounds[1:] - bounds[:-1])[asked]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
    where = np.repeat(bounds[asked] - ends[:-1], length) + np.arange(ends[-1])
    docs = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(r) // 4 for r in refs]))).astype(np.int64)
    return values[where], ends[docs]


def _encoded(df: DataFrame, doc_id: str, text: str, tokenizer: str, folder: str, block_chars: int, index_bytes: int, count_only: bool) -> DataFrame:
    spark = df.sparkSession
    kind = df.schema[doc_id].dataType
    table = spark.sparkContext.broadcast(vocabulary(folder, tokenizer))  # a vocabulary file of fixed size
    cut_schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_id", kind), T.StructField("refs", T.BinaryType()), T.StructField("piece", T.StringType()), T.StructField("at", T.IntegerType()),
    ])
    cut = written(spread(df.select(df[doc_id], df[text])).mapInArrow(lambda it: _cut(it, block_chars), cut_schema))
    tasks = max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    dictionary = cut.where("piece is not null").select("block", "at", "piece").repartition(tasks, "piece").sortWithinPartitions("piece")
    ids = dictionary.mapInArrow(lambda it: _replayed(it, merge_table(table.value), index_bytes, count_only), "block long, at int, ids binary")
    documents = cut.where("refs is not null").select("block", "doc_id", "refs")

    def back(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": docs.column("doc_id"), name: pa.array([], result)})
        numbers, bounds = _ragged(docs.column("refs").to_pylist(), words)
        if count_only:
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(numbers, dtype=np.int64)))[bounds]
            out = pa.array(np.diff(sums).astype(np.int32))
        else:
            out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(numbers))
        return pa.table({"doc_id": docs.column("doc_id"), name: out})

    name, result = ("n_tokens", pa.int32()) if count_only else ("ids", pa.list_(pa.int32()))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField(name, T.IntegerType() if count_only else T.ArrayType(T.IntegerType()))])
    return documents.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(back, schema)


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, block_chars: int = BLOCK_CHARS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id and ids of every row of df."""
    return _encoded(df, doc_id, text, tokenizer, folder, block_chars, index_bytes, False)


def sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, block_chars: int = BLOCK_CHARS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id and n_tokens of every row of df."""
    return _encoded(df, doc_id, text, tokenizer, folder, block_chars, index_bytes, True)
