"""Token ids of whole texts, from a tokenizer file of the tokenizers library."""

from __future__ import annotations

import array
import functools
import os
import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and pieces of words, whose ids one Python worker keeps; the memory is
#: given up and filled again beyond that.  It changes no result.
WORD_MEMORY = 150_000
PIECE_MEMORY = 300_000
LONGEST_KEPT = 64

# The characters for which the word rule below is the
# tokenizer's own (printable ASCII and the Latin-1 letters), and that rule.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PLAIN_BYTES = bytes(b for b in range(256) if PLAIN.fullmatch(chr(b)) or b in b" \n")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: One piece on its own if they end a word of letters.
TAIL = "!#$%&()*+,-./:;<=>?@[]^_{|}~"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Lower-case piece -> its ids as little-endian bytes, from the BPE model alone."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.tokenize, self.kind, self.letters = model.tokenize, kind, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_MEMORY:
            self.clear()
        written = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        out = array.array(self.kind, [t.id for t in self.tokenize(written)]).tobytes()
        if len(piece) <= LONGEST_KEPT:
            self[piece] = out
        return out


class Words(dict):
    """Lower-case word of plain characters -> its ids: cut into pieces, which the BPE model knows."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        core = word.rstrip(TAIL)
        if core.isalpha():
            out = self.pieces[core] + self.pieces[word[len(core):]] if len(core) < len(word) else self.pieces[core]
        else:
            out = b"".join(map(self.pieces.__getitem__, PLAIN_PIECES.findall(word)))
        if len(word) <= LONGEST_KEPT:
            self[word] = out
        return out


class WordIds:
    """Ids of texts as little-endian bytes.

    The tokenizer drops white space and none of its pieces spans it, so the
    ids of a text are those of its words between spaces and line ends.  A word
    of plain characters takes the short way of ``Words``; any other word, and
    one that may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.words = Words(Pieces(self.tokenizer.model, self.kind))
        self.plain = sys.byteorder == "little" and self.is_word_bpe()

    def is_word_bpe(self) -> bool:
        """The short way holds for this kind of tokenizer alone: no byte prefix, words ended by a suffix."""
        probe = "Don't re-use 3D é,Ü!! (x) a1b2 'S it's Größe... x'y' \"quoted\" ñandú?! __a__"
        return self.whole(probe) == b"".join(map(self.word, probe.split(" ")))

    def whole(self, text: str) -> bytes:
        return array.array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        return self.words[word.lower()] if "<|" not in word and PLAIN.fullmatch(word) else self.whole(word)

    def split(self, text: str) -> tuple[list[str], Callable[[str], bytes]]:
        """Words of a text and what gives the ids of one of them."""
        if not self.plain:
            return [text], self.whole
        try:
            odd = text.encode("latin-1").translate(None, PLAIN_BYTES) or "<|" in text
        except UnicodeEncodeError:
            odd = True
        text = text.replace("\n", " ")
        return (text.split(" "), self.word) if odd else (text.lower().split(" "), self.words.__getitem__)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words, of = self.split(text)
        return b"".join(map(of, words))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each tokenizer file and Python worker."""
    return WordIds(path)


def ids_array(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}")


def end_bytes(end_id: int | None, width: int) -> bytes:
    return b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()


def token_table(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """``docs (shard int, doc_id long, text string)`` -> ``(shard, before long, doc_id, ids binary)``.

    ``before`` counts the ids of the rows before it in its partition.
    """

    def encode(batches):
        words, before = word_ids(path), 0
        end = end_bytes(end_id, words.width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [words.encode(text) + end for text in part.column(2).to_pylist()]
                sizes = np.array([len(b) for b in ids], np.int64) // words.width
                ends = before + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - sizes), part.column(1), pa.array(ids, pa.binary())],
                                                 names=["shard", "before", "doc_id", "ids"])
                before = int(ends[-1])

    return docs.select("shard", "doc_id", "text").mapInArrow(encode, "shard int, before long, doc_id long, ids binary")


def token_counts(tokens: DataFrame, width: int) -> DataFrame:
    """``(token int, n long)``: how often each id occurs in the ``ids`` of a token table.

    Each task sums over its rows first and sends at most one row for each id.
    """

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                if len(ids.as_buffer() or b""):
                    n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                    if len(n) > len(total):
                        total = np.pad(total, (0, len(n) - len(total)))
                    total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": used.astype(np.int32), "n": total[used]})

    return tokens.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
