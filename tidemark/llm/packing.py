"""Cost-balanced packing of tokenised documents into training sequences of a fixed length.

Each task packs its own documents, block by block (a block ends after about BLOCK_TOKENS tokens), so nothing is
shuffled and memory is bounded by the block and the longest document. In a block, whole sequences are cut off the
front of documents longer than a sequence. The rest are taken in descending estimated cost, LINEAR * n + QUADRATIC * n²
(a projection term and the attention within a document), and each goes to the sequence of the lowest cost so far that
still has room for it; where none has, it is cut and fills the cheapest ones. The block's last
tokens, fewer than a sequence, go into sequences of power-of-two lengths, so that no sequence needs padding.

Token ids are those of the byte-level BPE vocabulary in the given rank file; special strings in a text become
their special ids, as the tokenizers library does with the same vocabulary. Each document ends with END_ID.
A text with more than BLANKS white-space characters in a row, on which the rank file's encoder runs out of stack, is
encoded by the tokenizers library and its file of the same vocabulary, which is slower and gives the same ids.

Cases: a null or empty text is the end id alone; rows with one doc_id are packed one by one; a null doc_id stays null;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

SEQUENCE = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
BLANKS = 20_000

_SCHEMA = "id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    tokenizer_path: str,
    special: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: id, start and length in the document's ids, token_bytes (little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id and offset in that sequence."""

    def run(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = _encoder(ranks_path, pattern, tokenizer_path, tuple(sorted((special or {}).items())))
        end, first = np.array([end_id], dtype="<u4"), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            nonlocal held, size, first
            rows, used = pack_block([len(ids) for _, ids in held], length, linear, quadratic)
            held_ids = [(held[d][0], held[d][1][a : a + n].tobytes(), len(held[d][1])) for d, a, n, _, _ in rows]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in held_ids], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([x[1] for x in held_ids], pa.binary()),
                    pa.array([x[2] for x in held_ids], pa.int64()),
                    pa.array([first + r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["id", "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"],
            )
            held, size, first = [], 0, first + used
            return out

        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end))
                held.append((doc, ids))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


def pack_block(sizes: list[int], length: int, linear: float, quadratic: float) -> tuple[list[tuple], int]:
    """Pieces (document, start, length, sequence, offset) of documents with these sizes, and the number of sequences."""
    rows, used, rest = [], 0, []
    for doc, n in enumerate(sizes):
        whole = n // length
        rows += [(doc, k * length, length, used + k, 0) for k in range(whole)]
        used += whole
        if n % length:
            rest.append((doc, whole * length, n % length))
    total = sum(n for _, _, n in rest)
    room = [length] * (total // length)
    tail = total % length
    room += [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    fill, none = [0] * len(room), (float("inf"), -1)
    heaps, width = [[] for _ in range(length + 1)], 1 << length.bit_length()
    least = [none] * (2 * width)  # a tree over the room left, of the cheapest sequence

    def changed(left: int):
        i = left + width
        least[i] = heaps[left][0] if heaps[left] else none
        while i := i // 2:
            least[i] = min(least[2 * i], least[2 * i + 1])

    def cheapest(left: int) -> tuple[float, int]:
        i = left + width
        found = least[i]
        while i > 1:
            if i % 2 == 0:
                found = min(found, least[i + 1])
            i //= 2
        return found

    for k, size in enumerate(room):
        heaps[size].append((0.0, k))
    for size in set(room):
        changed(size)
    for doc, start, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        while n:
            cost, k = cheapest(n)
            if k < 0:
                cost, k = cheapest(1)
            left = room[k] - fill[k]
            heapq.heappop(heaps[left])
            changed(left)
            piece = min(n, left)
            rows.append((doc, start, piece, used + k, fill[k]))
            fill[k] += piece
            start, n = start + piece, n - piece
            if fill[k] < room[k]:
                heapq.heappush(heaps[left - piece], (cost + linear * piece + quadratic * piece * piece, k))
                changed(left - piece)
    return rows, used + len(room)


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str, tokenizer_path: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    strings = [s for s, _ in special]
    blank = re.compile(rf"\s{{{BLANKS}}}")
    slow = []  # read when it is needed

    def encode(text: str) -> np.ndarray:
        if len(text) > BLANKS and blank.search(text):
            from tokenizers import Tokenizer

            slow or slow.append(Tokenizer.from_file(tokenizer_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        ids = encoding.encode(text, allowed_special="all") if any(s in text for s in strings) else encoding.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    return encode
