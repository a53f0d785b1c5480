"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

The merge loop takes the pair of least rank from a priority queue over a doubly linked list of symbols and skips entries
that a merge has made stale; decoding concatenates vocabulary strings. Pieces between blanks are encoded once per worker
and remembered, as the same words come back all the time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import id_and_text, slices

#: Remembered pieces per worker, and the longest that is remembered; both bound memory only.
REMEMBERED, LONGEST = 400_000, 48

#: A pair's key: the left id above these bits, the right one in them.
KEY = 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Join adjacent symbols in order of rank, leftmost first among equals, until no pair has a rank.

    ``symbols`` are vocabulary ids; ``ranks`` has (rank, id of the joined symbol) for each pair, by ``pair_key``. Queue
    entries are rank * n + place: one number. An entry is stale unless the pair that now stands at its place has its rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    at, prev, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    find, push, pop = ranks.get, heapq.heappush, heapq.heappop
    queue = [x[0] * n + i for i in range(n - 1) if (x := find(at[i] << KEY | at[i + 1]))]
    heapq.heapify(queue)
    while queue:
        rank, i = divmod(pop(queue), n)
        j = after[i]
        if j < 0 or at[i] < 0 or not (x := find(at[i] << KEY | at[j])) or x[0] != rank:
            continue
        at[i], at[j] = x[1], -1
        k = after[i] = after[j]
        if k >= 0:
            prev[k] = i
            if y := find(x[1] << KEY | at[k]):
                push(queue, y[0] * n + i)
        h = prev[i]
        if h >= 0 and (y := find(at[h] << KEY | x[1])):
            push(queue, y[0] * n + h)
    return [x for x in at if x >= 0]


class WordBPE:
    """A vocabulary with word ends as the ``tokenizers`` library reads it: NFC, white space to blanks, lower case, pattern, bytes, merges.

    It reads the special tokens, the pattern, the word end, the vocabulary and the merges from the file. White space
    between pieces never reaches a token, so each blank-free piece is encoded alone. Pieces beyond Latin letters are
    normalized and parted by the library, whose Unicode tables may be older than Python's.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or (first["type"], second["type"], second["use_regex"]) != ("Split", "ByteLevel", False) or spec["decoder"]:
            raise ValueError(f"{path} is not a vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {vocab[a] << KEY | vocab[b]: (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (*vocab.items(), *self.special.items())}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.mark = min(self.special, key=len)[:2]
        self.pattern = regex.compile(first["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + model["end_of_word_suffix"]] for s in symbols]
        self.inner_of = {s: vocab[s] for s in symbols}
        self.last_of = {s: vocab[s + model["end_of_word_suffix"]] for s in symbols}
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {"": (b"", b"")}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            raw = word.encode()
            ids = tuple(merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.ranks))
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            if len(word) <= LONGEST:
                self.words[word] = ids
        return ids

    def _plain(self, part: str) -> list[int]:
        found: list[int] = []
        if part.isascii() or max(part) < "\u0250":
            for word in self.pattern.findall((part if part.isascii() else unicodedata.normalize("NFC", part)).lower()):
                found += self._word(word)
        else:
            for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                found += merge([*map(self.inner_of.__getitem__, symbols[:-1]), self.last_of[symbols[-1]]], self.ranks)
        return found

    def ids(self, text: str) -> list[int]:
        """Ids of any text; specials are found before anything else."""
        if self.mark not in text:
            return self._plain(text)
        found: list[int] = []
        for part in self.special_pattern.split(text):
            found += [self.special[part]] if part in self.special else self._plain(part) if part else []
        return found

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a blank between them, as the library does where the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        ids = self.ids(piece)
        got = array("I", ids).tobytes(), self.decode(ids).encode("utf-8")
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
            self.pieces[""] = (b"", b"")
        if len(piece) <= LONGEST:
            self.pieces[piece] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        parts = (text or "").replace("\n", " ").split(" ")
        known = list(map(self.pieces.get, parts))
        if None in known:
            known = [k if k is not None else self.pieces.get(p) or self._piece(p) for k, p in zip(known, parts, strict=True)]
        ids, strings = zip(*known, strict=True)
        return b"".join(ids), b" ".join(filter(None, strings))


_loaded: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """The vocabulary, read once per worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` per row: the ids as little-endian unsigned 32-bit integers, the decoded text as UTF-8 bytes.

    A null or empty text, or one of white space, has no ids and an empty decoded text. Ids and repeated rows are kept as
    they are; an empty table gives no rows. ``path`` is the vocabulary file, present on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            done = [bpe.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what ``encode_texts`` returns, taken in the worker so that the ids don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            n, ids, strings = [], [], []
            for text in part.column(1).to_pylist():
                a, b = bpe.encode(text)
                n.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest())
                strings.append(hashlib.sha256(b).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(strings, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
