"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text becomes words that begin with the space mark. No piece holds a mark after another character, so
words are encoded one by one. The distinct words of a batch are sorted, which is a depth-first walk
through their trie: the forward state of each prefix (best score, last piece, where it began) is kept on
a stack and shared by all words with that prefix.

For a unigram model the state adds the pieces' scores. For a BPE model scores order merges and do not
add up; there a step from piece a to piece b has score 0 if merging the characters of ab gives a, b again
and minus infinity otherwise. Exactly one path has score 0, and it is what merging gives, because merges
on either side of a boundary that none of them crosses do not affect each other.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import slices, small_batches

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A SentencePiece model of type unigram or BPE whose normaliser is the identity."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for n, v in _fields(data):
            if n == 1:
                own = dict(_fields(v))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif n == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                own = dict(_fields(v))
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("only models without a character map are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes beyond a word")
        self.unknown = self.types.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        #: Every ending of a piece; the id of the piece that it is, or -1.
        self.tails = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.text_of = [self._bytes(i) for i in range(len(self.pieces))]
        self._fits: dict[int, bool] = {}
        self._packed: list[np.ndarray] = []
        self._words: dict[str, bytes] = {}

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.__dict__.update(_loaded(data).__dict__)

    def _bytes(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """BPE of a short string by merging: of adjacent pieces whose join is a piece, the best score first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of ab ends in a, b. a may be empty: whether those of b end in b."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def _step(self, word: str, end: int, stack: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        """State of the prefix of length end: of the pieces that can be its last, the one on the best path."""
        tails, size = self.tails, 1
        found = []
        while size <= end:
            i = tails.get(word[end - size : end])
            if i is None:  # no piece ends like this
                break
            if i >= 0:
                found.append((size, i))
            size += 1
        if self.kind == BPE:
            fits = self._fits
            for size, i in reversed(found):
                start = end - size
                _, last, before = stack[start]
                pair = before << 21 | i
                known = fits.get(pair)
                if known is None:
                    if len(fits) > 400_000:
                        fits.clear()
                    known = fits[pair] = self.fits(word[start - last : start], word[start:end])
                if known:
                    return 0.0, size, i
            return 0.0, 1, len(self.pieces) + ord(word[end - 1])
        best = (stack[end - 1][0] + self.lowest, 1, -1)
        for size, i in found:
            score = stack[end - size][0] + self.scores[i]
            if score > best[0]:
                best = (score, size, i)
        return best

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words in sorted order, by one depth-first walk through their trie."""
        step, pieces = self._step, len(self.pieces)
        # State of the prefix of length n: score, length and id of the last piece. stack[0] is the empty prefix.
        stack: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        before = ""
        for word in words:
            n = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                n += 1
            del stack[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                stack.append(step(word, end, stack))
            out, end = [], len(word)
            while end:
                _, size, i = stack[end]
                if 0 <= i < pieces:
                    out.append(i)
                elif self.byte:
                    out.extend(self.byte[b] for b in reversed(word[end - size : end].encode("utf-8", "replace")))
                else:
                    out.append(self.unknown)
                end -= size
            out.reverse()
            before = word
            yield word, out

    def _split(self, text: str) -> list[str]:
        """The marked words of a text."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return _CHUNK.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers; none for a null or empty text."""
        split = [self._split(t or "") for t in texts]
        self._unpack()
        known = self._words
        if len(known) > REMEMBERED:
            known.clear()
        for word, out in self.encode_words(sorted({w for ws in split for w in ws if w not in known})):
            known[word] = struct.pack(f"<{len(out)}i", *out)
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def forget(self) -> None:
        """Drop the remembered words. The pairs of pieces stay, as two arrays: numbers scattered among the words would keep the words' memory from going back."""
        self._unpack()
        fits = self._fits  # emptied in place, as all copies of a worker's model share it
        self._packed[:] = np.fromiter(fits.keys(), np.int64, len(fits)), np.fromiter(fits.values(), bool, len(fits))
        fits.clear()
        self._words.clear()

    def _unpack(self) -> None:
        """The pairs of pieces as a dict again."""
        if self._packed:
            pairs, known = self._packed
            self._fits.update(zip(pairs.tolist(), known.tolist(), strict=True))
            self._packed.clear()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, bytes as UTF-8 (wrong bytes replaced), no space in front."""
        text = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_MODELS: dict[bytes, PieceModel] = {}


def _loaded(data: bytes) -> PieceModel:
    """One model for each worker process, so that what it remembers serves all its tasks."""
    if data not in _MODELS:
        _MODELS[data] = PieceModel(data)
    return _MODELS[data]


def load(path: str = MODEL_PATH) -> PieceModel:
    """The model in a file that the driver can read; its bytes (under a few MB) go along with the tasks."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_documents(df: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, ids, n_tokens, roundtrip (decoding gives the text again).

    A null or empty text has no ids and is its own round trip (null counts as empty). A text that holds
    the mark itself comes back with spaces, so its roundtrip is false; lone surrogates can't occur in
    Spark strings. No shuffle; an empty table gives no rows. Other columns of df play no part.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, done=model.forget):
            texts = b.column(1).to_pylist()
            coded = [np.frombuffer(x, "<i4") for x in model.encode(texts)]
            sizes = np.array([len(x) for x in coded], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(coded).astype(np.int32)))
            same = [model.decode(x) == (t or "") for x, t in zip(coded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(sizes), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "roundtrip"])

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, n_tokens long, roundtrip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of (id, ids); null ids give a null text. Ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else model.decode(np.asarray(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
