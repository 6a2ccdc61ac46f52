"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bounded-space online best-fit: a packer keeps at most `open_bins` open sequences in a bitset
keyed by free space. A piece goes to the sequence with the least free space that still holds
it (the lowest set bit from its length on); where none does, a new sequence opens, and if all
places are taken the fullest one closes first. Work per piece does not depend on `open_bins`.
Of each `look_ahead` pieces that arrive the longest goes first; all of them are placed.

Packing runs in two levels. Every task packs its own rows and hands on the pieces of the
sequences that are still open at its end; these few are dealt to tasks of about `level_tokens`
tokens, which pack them again and close everything. No task sees all pieces.

Token ids come from a `tokenizers` file. Byte-level BPE never merges over the start of a
pre-token, so each word is encoded once by the file's model and then looked up in a bounded cache.
A text that holds an added token of the file (`<|endoftext|>`) is encoded by the whole tokenizer.

Defined results: a null text is empty, and every document ends with id `end_id`, so an empty
one is a piece of length 1; ids may be null or repeated, each row is packed; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.pretokens import PATTERN, SIGNS, Recent, cut_text, odd, of_plain
from logloom.plans.staging import stage

#: Words and other pre-tokens that a worker keeps in each of two generations.
LED_WORDS, BARE_TOKENS = 250_000, 50_000
DOCS_AT_ONCE = 256
#: Characters from which on a text is not put together with others.
LONG_TEXT = 16 << 20
#: Words whose ids are put in place together.
WORDS_AT_ONCE = 1 << 18
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                   ("ids", pa.binary())])
PIECE_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long,"
             " ids binary")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters
    stand for themselves, the other bytes follow from U+0100 on in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The vocabulary is a byte-level BPE whose pre-tokens are taken with an optional leading space.
    Pre-tokens are encoded by the tokenizer's model once and kept while they are in use; so are
    words with their signs. `encode` takes added tokens of the file as plain text, `whole` matches them.
    """

    _shared: dict[str, TokenIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as this machine's 32-bit integers, which must be little-endian")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = dict(enumerate(byte_letters()))
        self.words, self.bare = Recent(LED_WORDS), Recent(BARE_TOKENS)

    @classmethod
    def of(cls, path: str) -> TokenIds:
        """One per worker process, so that the caches serve all tasks of a worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def rest(self) -> None:
        """Between tasks only the younger generations are kept."""
        self.words.old, self.bare.old = {}, {}

    def _encode(self, token: str) -> bytes:
        letters = token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of a pre-token; those after a space are kept with the words."""
        cache, key = (self.words, token[1:]) if token[0] == " " and len(token) > 1 else (self.bare, token)
        if (ids := cache.new.get(key)) is None:
            ids = cache.new[key] = cache.old.get(key) or self._encode(token)
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self._token, PATTERN.findall(text)))

    def word(self, word: str) -> bytes:
        """Ids of a plain word."""
        ids = self.words.new[word] = self.words.old.get(word) or b"".join(map(self._token, of_plain(word)))
        return ids

    def encode(self, text: str) -> bytes:
        self.words.turn()
        self.bare.turn()
        head, words, plain = cut_text(text)
        if not plain:
            return self.plain(head) + b"".join([self.plain(" " + w) for w in words])
        found = list(map(self.words.new.get, words))
        if None in found:
            found = [self.word(w) if ids is None else ids for w, ids in zip(words, found)]
        return self.plain(head) + b"".join(found)

    def _all_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct plain words. Words of letters are kept; their ends of signs are put on each time."""
        new, old, letters, tokenize = self.words.new, self.words.old, self.letters, self.model.tokenize
        space, found = letters[32], list(map(new.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                word = words[k]
                stem = word.rstrip(SIGNS)
                if not stem.isalpha():
                    found[k] = b"".join(map(self._token, of_plain(word)))
                    continue
                if (ids := new.get(stem)) is None:
                    if (ids := old.get(stem)) is None:
                        token = space + stem if stem.isascii() else (" " + stem).encode().decode("latin-1").translate(letters)
                        ids = array("I", [t.id for t in tokenize(token)]).tobytes()
                    new[stem] = ids
                found[k] = ids if len(stem) == len(word) else ids + self._token(word[len(stem):])
        return found

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts on end, each as `whole` gives them, and how many each text has.

        Words that repeat among the texts are looked up once.
        """
        plain = [not (len(t) > LONG_TEXT or self.added and self.added.search(t) or odd(t)) for t in texts]
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") if p else "" for t, p in zip(texts, plain)], pa.string()), " ")
        first, words = cut.offsets.to_numpy()[:-1], cut.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        # the first word of a text follows no space; it stands for the whole text if that is not plain
        starts = words.dictionary.take(words.indices.take(pa.array(first))).to_pylist()
        own = [self.plain(start) if p else self.whole(t) for t, p, start in zip(texts, plain, starts)]
        later = np.ones(len(codes), bool)
        later[first] = False
        used = np.flatnonzero(np.bincount(codes[later], minlength=len(words.dictionary)))
        self.words.turn()
        self.bare.turn()
        found = self._all_words(words.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist()) + own
        place = np.zeros(len(words.dictionary) + 1, np.int32)
        place[used] = np.arange(len(used))
        at = place[codes]
        at[first] = len(used) + np.arange(len(texts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        ids = [np.empty(0, "<u4")]
        for k in range(0, len(at), WORDS_AT_ONCE):
            part = at[k:k + WORDS_AT_ONCE]
            n = sizes[part]
            ends = np.cumsum(n)
            ids.append(flat[np.repeat(begin[part] - (ends - n), n) + np.arange(ends[-1])])
        return np.concatenate(ids), np.add.reduceat(sizes[at], first) if texts else sizes

    def whole(self, text: str) -> bytes:
        """Ids of a text as the tokenizer gives them, its added tokens included."""
        if self.added and self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.encode(text)


class Packer:
    """Bounded-space online best-fit over pieces of 1 to capacity tokens."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free space: stacks of sequences
        self.bits, self.n_open = 0, 0

    def _take(self, free: int) -> list:
        pieces = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return pieces

    def add(self, length: int, piece) -> list | None:
        """Place a piece; the pieces of the sequence that closes, if one does."""
        fitting = self.bits >> length
        closed = None
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            pieces = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            free, pieces = self.capacity, []
        pieces.append(piece)
        free -= length
        if free == 0:
            return pieces if closed is None else [closed, pieces]
        self.by_free[free].append(pieces)
        self.bits |= 1 << free
        self.n_open += 1
        return closed

    def rest(self) -> Iterator[list]:
        for stack in self.by_free:
            yield from stack


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


class _Out:
    """Collects placed rows into batches; numbers sequences by level, task and order."""

    def __init__(self, level: int) -> None:
        self.next_id = level << 60 | TaskContext.get().partitionId() << 32
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p[:5], self.next_id, offset, p[5]))
            offset += p[3]
        self.next_id += 1

    def leave(self, pieces: list[tuple]) -> None:
        self.rows.extend((*p[:5], None, None, p[5]) for p in pieces)

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*self.rows), PIECE)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=PIECE)


def _longest_first(pieces: Iterator[tuple], look_ahead: int) -> Iterator[tuple]:
    while window := list(islice(pieces, look_ahead)):
        yield from sorted(window, key=lambda p: -p[3])


def _pack(pieces: Iterator[tuple], out: _Out, capacity: int, open_bins: int, look_ahead: int,
          close: bool) -> Iterator[pa.RecordBatch]:
    packer = Packer(capacity, open_bins)
    for piece in _longest_first(pieces, look_ahead):
        if piece[3] == capacity:
            out.place([piece])
        elif closed := packer.add(piece[3], piece):
            for sequence in closed if isinstance(closed[0], list) else [closed]:
                out.place(sequence)
        yield from out.batch(10_000)
    for sequence in packer.rest():
        (out.place if close else out.leave)(sequence)
    yield from out.batch()


def _first_level(path: str, end_id: int, capacity: int, open_bins: int, look_ahead: int,
                 with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            token_ids = TokenIds.of(path)
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                    part = batch.slice(at, DOCS_AT_ONCE)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        ids = token_ids.whole(text or "") + end
                        for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                            own = ids[4 * start:4 * (start + length)]
                            yield doc_id, n, start, length, zlib.crc32(own), own if with_ids else None
            token_ids.rest()

        yield from _pack(pieces(), _Out(0), capacity, open_bins, look_ahead, close=False)

    return run


def _second_level(capacity: int, open_bins: int, look_ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*r[:5], r[7]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _pack(rows, _Out(1), capacity, open_bins, look_ahead, close=True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         capacity: int = 2048, open_bins: int = 2048, look_ahead: int = 20_000,
         level_tokens: int = 50_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    found = stage(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
                  .mapInArrow(_first_level(tokenizer_path, end_id, capacity, open_bins, look_ahead, with_ids), PIECE_DDL), "packed")
    left = found.filter("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = (left.repartition(-(-tokens // level_tokens) or 1, "doc_id", "piece", "ids_crc32")
             .mapInArrow(_second_level(capacity, open_bins, look_ahead), PIECE_DDL))
    both = found.filter("sequence_id is not null").unionByName(again)
    return both if with_ids else both.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, length, ids (binary, 32-bit).

    A sequence holds at most `capacity` tokens, which bounds the list of its pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
                    F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
