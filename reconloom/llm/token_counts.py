"""Exact token counts at every prefix of a text, by dynamic programming over words.

The vocabulary is BPE with word ends: texts are normalised, cut into words by a pattern, and the last byte of a word is another
symbol than the same byte inside one. A text's prefix has the tokens of its whole words and those of one cut word.

Words are encoded by their prefixes. Merging the symbols of a word ends in the only sequence of tokens in which
every two neighbours stay apart when the symbols of just these two are merged. So the last token of an open prefix (one whose word
goes on) is the one token that ends there and stays apart from the last token of the prefix before it, and its count is one more than
that prefix's. The count of a closed prefix (one that ends the word) follows in the same way from the open prefixes, with
tokens that bear the word's end. One pass gives the counts of all prefixes; nothing is encoded twice.

Whether two tokens stay apart is read off the merges that made them: the right edge of the first and the left edge of
the second grow in steps of known rank, and a merge across them must not come before the next step.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import packed, slices, small_batches

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words and chunks that a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 500_000
#: Longer chunks (code points) are not remembered.
LONGEST_KEPT = 64
#: Code points of a stored piece of a text's counts.
PIECE = 16_384
NEVER = 1 << 30

#: White space of the normaliser, as a pattern (what Unicode calls White_Space); str.split() also cuts at the four before \\x20.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = regex.compile(f"[^{_SPACE}]+")
#: Lower case where str.lower() differs: sigma at a word's end, two letters that Unicode has only had since its version 16.
_LATER = (("Σ", "σ"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
#: Contractions of the word pattern; one of three characters is two words as long as it lacks the last.
_LATE = {"'re", "'ve", "'ll"}


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the file: printable ones for themselves, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """A BPE vocabulary with word ends, from the JSON file of the `tokenizers` library.

    Supported is what word_bpe_49k.json has: NFC, white space and lower case as normalisers, words by a pattern, bytes as symbols, a
    suffix for a word's end, every byte a token, merges that build on earlier ones, special tokens taken from the raw text.
    """

    def __init__(self, data: bytes):
        self.data = data
        spec = json.loads(data)
        model, words = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or [w["type"] for w in words] != ["Split", "ByteLevel"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("only BPE with word ends over NFC, lower-case text is supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only special tokens of the raw text are supported")
        self.words = regex.compile(words[0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        symbols, end = _byte_symbols(), model["end_of_word_suffix"]

        def raw(token: str) -> str:
            return "".join(chr(symbols[c]) for c in token)

        #: Ids of tokens inside a word and of tokens at its end, by their bytes.
        self.open: dict[str, int] = {}
        self.closed: dict[str, int] = {}
        added = {t["content"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in added:
                (self.closed if token.endswith(end) else self.open)[raw(token.removesuffix(end))] = i
        if any(chr(b) not in d for b in range(256) for d in (self.open, self.closed)):
            raise ValueError("every byte has to be a token")
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # by token: its two parts and the rank of their merge
        for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            ia, ib, it = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if it in self.made or any(k < self.made[i][2] for i in (ia, ib) if i in self.made):
                raise ValueError("every merge has to make a new token of earlier ones")
            self.rank[ia, ib], self.made[it] = k, (ia, ib, k)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.open.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.closed_tails = {t[k:]: -1 for t in self.closed for k in range(len(t))} | self.closed
        self.reach = max(map(len, (*self.open, *self.closed)))
        self._edges: tuple[dict, dict] = ({}, {})
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._words: dict[str, bytes | array] = {}
        self._sizes: dict[str, int] = {}
        self._chunks: dict[str, int] = {}

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.__dict__.update(_loaded(data).__dict__)

    # Tokens

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that ends it) of what stands at one edge of a token while it is made; side 0 left, 1 right."""
        known = self._edges[side].get(token)
        if known is None:
            out, t, until = [], token, NEVER
            while t in self.made:
                out.append((t, until))
                until = self.made[t][2]
                t = self.made[t][side]
            out.append((t, until))
            known = self._edges[side][token] = out[::-1]
        return known

    def _meet(self, a: int, b: int) -> int:
        """Rank of the first merge across the boundary of a and b when their symbols are merged; NEVER if they stay apart."""
        right, left = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.rank.get((x, y), NEVER)
            # Of equal ranks the leftmost goes first: the step in a, then the merge across, then the step in b.
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return rank
            if x_ends == y_ends == NEVER:
                return NEVER
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether merging a token's symbols gives the token."""
        known = self._whole.get(token)
        if known is None:
            if token in self.made:
                a, b, rank = self.made[token]
                known = self.whole(a) and self.whole(b) and self._meet(a, b) == rank
            else:
                known = True
            self._whole[token] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: begin a word): merging b's symbols gives b, and no merge across the boundary comes first."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 2 * REMEMBERED:
                self._apart.clear()
            known = self._apart[key] = self.whole(b) and (a < 0 or self._meet(a, b) == NEVER)
        return known

    # Words, as text of one character for each byte

    def _forward(self, word: str, last: list[int], count: list[int]) -> None:
        """Carry on last token and count of the open prefixes, from those of the first len(last) - 1 bytes to the whole word.

        Nearly all the time goes here. The automaton gives what ends at a place, longest first; the first that may stand is it.
        """
        done, apart = len(last) - 2, self._apart
        for end, (t, size) in self.automaton.iter(word):
            if end > done:
                at = end + 1 - size
                key = last[at] << 20 | t
                if apart[key] if key in apart else self.apart(last[at], t):
                    last.append(t)
                    count.append(count[at] + 1)
                    done = end

    def _close(self, word: str, end: int, last: list[int], count: list[int]) -> int:
        """Count of the closed prefix word[:end]."""
        tails, found, at = self.closed_tails, [], end - 1
        while at >= 0:
            t = tails.get(word[at:end])
            if t is None:
                break
            if t >= 0:
                found.append((t, at))
            at -= 1
        for t, at in reversed(found):
            if self.apart(last[at], t):
                return count[at] + 1
        raise AssertionError("a byte is always a token")

    def word(self, word: str) -> bytes | array:
        """Token counts of a word's prefixes, one for each code point."""
        known = self._words.get(word)
        if known is None:
            code, last, count = _bytes(word), [-1], [0]
            self._forward(code[:-1], last, count)
            out = [self._close(code, end, last, count) for end in _ends(code)]
            if word in _LATE:
                out[1] = out[0] + self.word(word[1])[0]
            known = bytes(out) if max(out) < 256 else array("I", out)
            if len(word) <= LONGEST_KEPT:
                if len(self._words) > REMEMBERED:
                    self._words.clear()
                self._words[word] = known
        return known

    def size(self, word: str) -> int:
        """Token count of a word: of its prefixes only the last is closed."""
        code, last, count = _bytes(word), [-1], [0]
        self._forward(code[:-1], last, count)
        return self._close(code, len(code), last, count)

    # Texts

    def _normal(self, text: str) -> str:
        """Composed and in lower case, character by character, as Σ is σ everywhere."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        for a, b in _LATER:
            if a in text:
                text = text.replace(a, b)
        return text.lower()

    def _of_normal(self, text: str) -> array:
        """Counts of the prefixes of a normalised text without white space."""
        out, base = array("I"), 0
        for w in self.words.findall(text):
            counts = self.word(w)
            out.extend([base + c for c in counts] if base else counts)
            base = out[-1]
        return out

    def chunk_prefixes(self, chunk: str) -> array:
        """Counts of the prefixes of a raw text without white space, one for each code point."""
        normal = self._normal(chunk)
        if chunk.isascii() or len(normal) == len(chunk) and unicodedata.is_normalized("NFC", chunk):
            return self._of_normal(normal)
        # Characters that change or compose: cut where nothing composes, and count each cut inside such a cluster by itself.
        starts = [i for i, c in enumerate(chunk) if not i or _alone(c)] + [len(chunk)]
        parts = [self._normal(chunk[i:j]) for i, j in itertools.pairwise(starts)]
        normal = "".join(parts)
        whole, words = self._of_normal(normal), [m.start() for m in self.words.finditer(normal)]
        out, at, held = array("I"), 0, {}
        for (i, j), part in zip(itertools.pairwise(starts), parts, strict=True):
            for k in range(i + 1, j):
                out.append(self._after(normal, at, self._normal(chunk[i:k]), whole, words, held))
            at += len(part)
            out.append(whole[at - 1])
        return out

    def _after(self, normal: str, at: int, more: str, whole: array, words: list[int], held: dict) -> int:
        """Count of normal[:at] + more. Only the word before the cut is looked at again, and of a long word only its last bytes.

        whole has the counts of normal's prefixes, words the starts of its words, held the open prefixes of the last long word.
        """
        if not at:
            return self._total(more)
        k = bisect_right(words, at - 1) - 1
        begin = words[k - 1] if k and words[k] - words[k - 1] == 1 else words[k]  # an apostrophe before it may belong to it
        base = whole[begin - 1] if begin else 0
        if at - begin <= LONGEST_KEPT:
            return base + self._total(normal[begin:at] + more)
        begin = words[k]
        if held.get("begin") != begin:
            word = _bytes(normal[begin : words[k + 1] if k + 1 < len(words) else len(normal)])
            last, count = [-1], [0]
            self._forward(word, last, count)
            held.update(begin=begin, base=whole[begin - 1] if begin else 0, last=last, count=count, at=begin, bytes=0)
        held["bytes"] += len(_bytes(normal[held["at"] : at]))  # cuts come in ascending order
        held["at"] = at
        tail = normal[at - 8 : at]  # enough to know what the run is, and no whole contraction
        first = self.words.match(tail + more)
        added = _bytes((tail + more)[len(tail) : max(first.end(), len(tail))])
        rest = self._total((tail + more)[max(first.end(), len(tail)) :])
        if not added:
            return whole[at - 1] + rest
        n = held["bytes"]
        low = max(0, n - self.reach)
        word = _bytes(normal[at - self.reach : at])[-(n - low) :] + added
        last, count = held["last"][low : n + 1], held["count"][low : n + 1]
        self._forward(word[:-1], last, count)
        return held["base"] + self._close(word, len(word), last, count) + rest

    def _total(self, normal: str) -> int:
        return sum(self.word(w)[-1] for w in self.words.findall(normal))

    def chunk(self, chunk: str) -> int:
        """Number of tokens of a raw text without white space; of its words only the last prefix is closed."""
        n = 0
        for w in self.words.findall(self._normal(chunk)):
            own = self._sizes.get(w)
            if own is None:
                own = self.size(w)
                if len(w) <= LONGEST_KEPT:
                    if len(self._sizes) > REMEMBERED:
                        self._sizes.clear()
                    self._sizes[w] = own
            n += own
        if len(chunk) <= LONGEST_KEPT:
            if len(self._chunks) > REMEMBERED:
                self._chunks.clear()
            self._chunks[chunk] = n
        return n

    def _ordinary(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _segments(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(begin, end, end of the special token that follows or end) of the stretches between special tokens."""
        at = 0
        if self.special is not None and "<|" in text:
            for m in self.special.finditer(text):
                yield at, m.start(), m.end()
                at = m.end()
        yield at, len(text), len(text)

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        n = 0
        for a, b, c in self._segments(text):
            known = self._chunks
            own = self._ordinary(text if b - a == len(text) else text[a:b])
            n += sum([known[x] if x in known else self.chunk(x) for x in own]) + (c > b)
        return n

    def prefixes(self, text: str, limit: int | None = None) -> np.ndarray:
        """Numbers of tokens of the prefixes of a text, from the empty one to the whole: one more than its code points.

        With a limit it stops where no longer prefix can have so few tokens.
        """
        out, base = np.zeros(len(text) + 1, np.int64), 0
        for a, b, c in self._segments(text):
            until = max(b, c - 1)  # inside a special token a prefix does not know of it yet
            total = whole = base
            at = a
            for m in _CHUNK.finditer(text[a:until]):
                i, j = a + m.start(), a + m.end()
                out[at + 1 : i + 1] = total
                if limit is not None and total > limit:
                    return out[: i + 1]
                out[i + 1 : j + 1] = self.chunk_prefixes(m[0])
                out[i + 1 : j + 1] += total
                if i < b:
                    whole = int(out[min(j, b)])
                total, at = int(out[j]), j
            out[at + 1 : until + 1] = total
            base = whole
            if c > b:
                base += 1
                out[c] = base
        return out

    def longest_within(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most `limit` tokens. Prefix counts are looked at only in the word that the limit falls in."""
        if self.special is not None and self.special.search(text):
            return int(np.flatnonzero(self.prefixes(text, limit) <= limit)[-1])
        base, known, chunks = 0, self._chunks, self._ordinary(text)
        for m, x in enumerate(chunks):
            n = known[x] if x in known else self.chunk(x)
            if base + n > limit:
                rest = next(itertools.islice(_CHUNK.finditer(text), m, None)).start()
                within = [i for i, c in enumerate(self.chunk_prefixes(x), 1) if base + c <= limit]
                return rest + (within[-1] if within else 0)
            base += n
        return len(text)

    def forget(self) -> None:
        """Drop the remembered words and chunks; pairs of tokens stay, they are few."""
        self._words.clear()
        self._sizes.clear()
        self._chunks.clear()


def _bytes(text: str) -> str:
    """One character for each byte of the text's UTF-8."""
    return text if text.isascii() else text.encode().decode("latin-1")


def _ends(code: str) -> list[int]:
    """Ends of the code points of a word given by `_bytes`."""
    n = len(code)
    return list(range(1, n + 1)) if code.isascii() else [i for i in range(1, n + 1) if i == n or ord(code[i]) & 0xC0 != 0x80]


_SECONDS: set[str] = set()


def _alone(c: str) -> bool:
    """Whether nothing before c can compose with it."""
    if not _SECONDS:
        pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
        _SECONDS.update(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<"))
        _SECONDS.update(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))  # vowels and finals of Korean syllables
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _SECONDS


_MODELS: dict[bytes, WordBpe] = {}


def _loaded(data: bytes) -> WordBpe:
    """One vocabulary for each worker process, so that what it remembers serves all its tasks."""
    if data not in _MODELS:
        _MODELS[data] = WordBpe(data)
    return _MODELS[data]


def load(path: str = VOCABULARY) -> WordBpe:
    """The vocabulary in a file that the driver can read; its bytes (under a few MB) go along with the tasks."""
    with open(path, "rb") as f:
        return WordBpe(f.read())


def token_counts(df: DataFrame, model: WordBpe, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_bytes, n_tokens, over_limit, cut.

    n_bytes are the text's UTF-8 bytes, n_tokens its tokens, over_limit says whether these are more than `limit`, and cut is the number
    of code points of the longest prefix of at most `limit` tokens (all of them if the text is within). A null text counts as
    empty: no bytes, no tokens. Repeated rows are counted one by one. No shuffle; an empty table gives no rows. Other columns
    of df play no part. A text is held whole, with one number for each of its code points where it is over the limit.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):  # the next task's texts have most of these words too, so they are kept
            texts = b.column(2).to_pylist()
            counts = [model.count(t) if t else 0 for t in texts]
            cuts = [len(t or "") if n <= limit else model.longest_within(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(cuts, pa.int64())], names=["id", "n_bytes", "n_tokens", "over_limit", "cut"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut long").withColumnRenamed("id", id_col)


def prefix_counts(df: DataFrame, model: WordBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored counts: id, text_key, first, counts; counts[i] is the number of tokens of the text's first `first + i` code points.

    A text of n code points has n + 1 counts, in rows of 16,384 at most. text_key is xxhash64 of the text, so that rows that share
    an id are told apart; equal rows have equal counts. A null or empty text has the one count 0.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64, done=model.forget):
            for k in range(b.num_rows):
                counts = model.prefixes(b.column(2)[k].as_py() or "").astype(np.int32)
                firsts = range(0, len(counts), PIECE)
                edges = pa.array([*firsts, len(counts)], pa.int32())
                same = pa.array([k] * len(firsts), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), pa.array(firsts, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(counts))], names=["id", "text_key", "first", "counts"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key long, first long, counts array<int>").withColumnRenamed("id", id_col)


def longest_prefixes(stored: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Of stored counts: id, text_key, chars, the length of the longest prefix of at most `limit` tokens. Nothing is encoded."""
    within = F.array_max(F.transform("counts", lambda c, i: F.when(c <= limit, F.col("first") + i)))
    return stored.select(id_col, "text_key", within.alias("chars")).groupBy(id_col, "text_key").agg(F.max("chars").alias("chars"))


def tokens_at(stored: DataFrame, asked: DataFrame, id_col: str = "doc_id", chars_col: str = "chars") -> DataFrame:
    """asked (id, chars, more) with column n_tokens: tokens of the text's first `chars` code points, null beyond its end. Nothing is encoded."""
    held = packed(asked, id=F.col(id_col), chars=F.col(chars_col), at=F.floor(F.col(chars_col) / PIECE) * PIECE)
    own = stored.select(F.col(id_col).alias("own"), "first", "counts").dropDuplicates(["own", "first", "counts"])
    hit = held.join(own, held["id"].eqNullSafe(own["own"]) & (F.col("at") == F.col("first")), "left")
    return hit.select("row.*", F.get("counts", (F.col("chars") - F.col("first")).cast("int")).alias("n_tokens"))
