"""Best-fit decreasing packing of token pieces into sequences of a fixed size.

Texts become token pieces where they are read (one pass, no shuffle of texts). The pieces, small rows without tokens, are dealt
evenly into blocks of a bounded number of rows, whatever their ids or sources, and each block is packed by best-fit
decreasing: a segment tree over the remaining capacities finds the tightest open sequence in logarithmic time. Each block
leaves at most about one sequence's worth of room unused beyond what best fit leaves, so the loss from blocks is bounded by
one sequence in thousands.

Defined cases: null and empty texts are one piece with the end id alone; repeated rows are packed each; ties in length go by
document and piece; other columns are dropped; an empty table gives an empty result. Texts have no length limit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, map_texts

#: Pieces that one task packs at most (about), and words whose ids a worker keeps.
BLOCK_ROWS = 16_384
KEEP = 400_000
#: Texts with these characters are left to the library as a whole: classes of rare characters may differ between regex engines.
RARE = re.compile(r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0530-\U0010ffff]")
#: Fixed value: the vocabulary's split into words, in classes of Python's re that mean the same for all other characters.
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


class WordIds(dict):
    """Little-endian 32-bit ids of the vocabulary's words, by the library when first met."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEEP:
            self.clear()
        spelt = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.merge(spelt)], dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if RARE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, WORDS(text)))


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(n: int, size: int) -> list[int]:
    """Starts of the pieces of ``n`` ids, and ``n``: all but the first piece are full."""
    first = (n - 1) % size + 1
    return [0, *range(first, n + 1, size)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer_file: str | None = None, text: str = "text") -> DataFrame:
    """A row for each piece of each document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_ids(tokenizer_file or default_tokenizer())
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = vocabulary.ids(value.as_py()) + end
                marks = cut_points(len(data) // 4, size)
                rows += [(doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(marks, marks[1:]))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


class Capacities:
    """Open sequences by room left: a segment tree whose leaves are capacities tells which are in use."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.open: list[list] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence) -> None:
        if not self.open[room]:
            k = room + self.leaves
            while k:
                self.used[k] += 1
                k >>= 1
        self.open[room].append(sequence)

    def take(self, least: int):
        """The tightest sequence with ``least`` room or more and its room, or None. It is taken out."""
        used, k = self.used, least + self.leaves
        if not used[k]:
            while k > 1 and (k & 1 or not used[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if used[2 * k] else 2 * k + 1
        room = k - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            while k:
                used[k] -= 1
                k >>= 1
        return room, sequence


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each item; items come longest first, none above ``size``."""
    rooms, sequences, offsets, made = Capacities(size), [], [], 0
    for n in lengths:
        room, sequence = rooms.take(n) or (size, None)
        if sequence is None:
            sequence, made = made, made + 1
        sequences.append(sequence)
        offsets.append(size - room)
        if room > n:
            rooms.add(room - n, sequence)
    return sequences, offsets


PACKED = f"{PIECES}, sequence_id long, offset long"


def pack_pieces(pieces: DataFrame, size: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is checkpointed: rows are dealt to blocks by position, evenly."""
    pieces = cut(pieces)
    blocks = max(1, -(-pieces.count() // block_rows))

    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        keys = [table[c].to_numpy(zero_copy_only=False) for c in ("ids_crc32", "piece", "doc_id")]
        order = np.lexsort([*keys, -length])
        sequences, offsets = best_fit(length[order].tolist(), size)
        base = table["block"][0].as_py() << 32
        table = table.drop_columns(["block"]).take(pa.array(order))
        return table.append_column("sequence_id", pa.array(base + np.array(sequences, dtype=np.int64))).append_column("offset", pa.array(offsets, pa.int64()))

    # ids run within partitions, so the sum of partition and position deals each partition's rows round the blocks
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("block", F.pmod(place.bitwiseAND((1 << 33) - 1) + F.shiftright(place, 33), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer_file: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return pack_pieces(token_pieces(docs, size, end_id, tokenizer_file), size, block_rows)
