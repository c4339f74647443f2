"""Cost-balanced packing of documents into fixed token sequences.

Each document is tokenised, gets an end token, and is cut into pieces of at most a sequence. Within a block of tokens the
sequences' capacities add up to exactly the block: full sequences, then powers of two for what is left, so no sequence
needs padding. Pieces go in descending order to the sequence of lowest cost (linear in its tokens plus quadratic in each
piece's) among those with room for them; a piece that fits nowhere is cut to the room there is.

Null and empty texts are one end token. Equal ids are separate documents. Very long texts are cut like others. A block is
what one task reads until `block_tokens` are there, so memory is bounded whatever the partition; nothing is shuffled, and
a lost task gives the same sequences again. An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import heapq
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEQUENCE, END = 4096, 2
#: Letters that Python lower-cases by their neighbours, or to several characters.
CASED = re.compile("[\u0130\u03a3]")
#: ASCII signs that follow letters as one piece; an apostrophe may belong to the letters after it.
SIGNS = "".join(c for c in string.punctuation if c != "'")
#: Entries a worker keeps of words seen, so that its memory is bounded.
CHUNKS, WORDS, ENDS = 80_000, 120_000, 2_000


class Ids:
    """Token ids of texts, word by word.

    The vocabulary's normaliser and splitter never look across ASCII white space, so a text's ids are those of its
    white-space-separated chunks in turn. Chunks and words already seen are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        every_byte = [*range(0x80, 0x800), *range(0x800, 0xD800, 0x400), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x40000)]
        self.bytes = {b: c for point in every_byte for b, c in zip(chr(point).encode(), shown(chr(point))[0][0], strict=True)}
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}

    def of_word(self, word: str) -> bytes:
        """Of normalised letters, which the splitter leaves whole; the model sees each byte as a character."""
        ids = self.words.get(word)
        if ids is None:
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            ids = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
            if len(self.words) < WORDS:
                self.words[word] = ids
        return ids

    def of_any(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def of_end(self, signs: str) -> bytes:
        ids = self.ends.get(signs)
        if ids is None:
            ids = self.of_any(signs)
            if len(self.ends) < ENDS:
                self.ends[signs] = ids
        return ids

    def of_chunk(self, chunk: bytes) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            text = chunk.decode()
            word = text.rstrip(SIGNS)  # after letters, a run of signs is a piece of its own
            if word.isalpha() and is_normalized("NFC", word) and not CASED.search(word):
                ids = self.of_word(word.lower()) + self.of_end(text[len(word):])
            else:
                ids = self.of_any(text)
            if len(self.chunks) < CHUNKS:
                self.chunks[chunk] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        known, of_chunk = self.chunks.get, self.of_chunk
        return b"".join([known(c) or of_chunk(c) for c in (text or "").encode().split()])


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def capacities(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences, then falling powers of two, that hold just so many tokens."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], sequence: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents are numbered as given."""
    room = np.array(capacities(sum(lengths), sequence), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    heap = [(-min(sequence, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, sequence)]
    heapq.heapify(heap)
    out = []
    while heap:
        minus, d, s = heapq.heappop(heap)
        n = -minus
        fits = room >= n
        k = int(np.where(fits, cost, np.inf).argmin())
        if not fits[k]:
            k = int(room.argmax())
            heapq.heappush(heap, (int(room[k]) - n, d, s + int(room[k])))
            n = int(room[k])
        out.append((d, s, n, k, int(size[k] - room[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    return out


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end: int = END, block_tokens: int = 2_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    sequence_id is unique over all tasks: the task's number and a count within it."""
    rows = common.ship(df).select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    names = [id_col, *PIECES.fieldNames(), *["ids"] * with_ids]
    tail = np.array([end], "<u4").tobytes()

    def emit(ids: list, tokens: list[bytes], first: int, part: int) -> tuple[list[pa.RecordBatch], int]:
        pieces = assign([len(t) // 4 for t in tokens], sequence)
        d, s, n, k, o = zip(*pieces, strict=True)
        bodies = [tokens[a][4 * b : 4 * (b + c)] for a, b, c in zip(d, s, n, strict=True)]
        of = lambda x: pa.array(x, pa.int64())
        cols = [pa.array([ids[x] for x in d], id_type), of(s), of(n), of([zlib.crc32(b) for b in bodies]), of([len(tokens[x]) // 4 for x in d]), of([(part << 40) + first + x for x in k]), of(o)]
        if with_ids:
            cols.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in bodies], pa.list_(pa.int32())))
        return [pa.RecordBatch.from_arrays(cols, names)], first + max(k) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, of = TaskContext.get().partitionId(), 0, ids_of(tokenizer).of_text
        ids, tokens, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens.append(of(text.as_py()) + tail)
                ids.append(i.as_py())
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    out, first = emit(ids, tokens, first, part)
                    yield from out
                    ids, tokens, held = [], [], 0
        if ids:
            yield from emit(ids, tokens, first, part)[0]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(df.schema[id_col].dataType)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *PIECES.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return rows.mapInArrow(common.tidied(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
