"""Byte-pair vocabularies and merging, shared by the tokenizer operators.

Two public vocabularies are supported, both read from the path that the caller
gives: a byte-level one (``ByteLevelCounter``) and a lower-casing one with word
ends (``WordEndCodec``).

``WordEndCodec`` encodes long unsplit text by tree concatenation: halves of halves
are encoded on their own, by threads side by side, then windows around each join
are encoded again and grown until they agree with the tokens of both sides.
Agreement is exact, not a guess:

* between words, the splitting pattern has no look-behind, so a scan is
  memoryless at the start of a match; once the window's scan and the right
  half's scan start a word at the same place, they agree from there on;
* inside one word, a token sequence is the byte-pair encoding of its text if
  every two neighbouring tokens are the encoding of theirs, so a window whose
  first and last tokens are those of the two sides proves the joined sequence.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import regex

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
#: Texts without these characters are split by the compiled patterns below, the
#: same as by the library (a test tries every one); others by its own splitter
#: or by ``regex`` classes.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ſ‐-‧‰-⁞]")

WORD_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
GPT_FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)
GPT_FULL = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


#: Characters of a text, and of a word, up to which a leaf is encoded at one go.
LEAF_CHARS, LEAF_WORD = 1_024, 12


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@functools.cache
def _to_alphabet() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


def mapped(text: str) -> str:
    """A text as its UTF-8 bytes in the byte alphabet."""
    return text.encode("utf-8").decode("latin-1").translate(_to_alphabet())


def unsplit_pieces(pattern_fast, pattern_full, text: str) -> list[str]:
    return (pattern_full if UNUSUAL.search(text) else pattern_fast).findall(text)


class Bounded(dict):
    """A cache of ``make(key)`` in two generations of ``limit`` entries.

    A full generation becomes the old one; keys found there move to the new one,
    so frequent keys stay. An executor may hold several idle workers, each with
    its caches, so they are kept to some tens of megabytes.
    """

    def __init__(self, make, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def read_vocabulary(path: str) -> dict:
    """Vocabulary file; ``path`` may be any local path, the same on all executors."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class ByteLevelCounter:
    """Counts tokens of a byte-level vocabulary without making identifiers.

    Each pre-token is a doubly linked list of symbols and a heap of adjacent
    pairs by rank, then place. Popping the lowest pair merges it; the count is
    the symbols at first less the merges.
    """

    def __init__(self, path: str):
        spec = read_vocabulary(path)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache = Bounded(self.count_piece)

    def count_piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        symbols = list(mapped(piece))
        n = len(symbols)
        if n < 2:
            return n
        rank = self.ranks.get
        heap = []
        for i in range(n - 1):
            r = rank((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            r, i = pop(heap)
            a, j = symbols[i], after[i]
            if a is None or j >= n or rank((a, symbols[j])) != r:
                continue  # the pair has gone since
            a = symbols[i] = a + symbols[j]
            symbols[j] = None
            merges += 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank((a, symbols[j]))
                if r is not None:
                    push(heap, (r, i))
            j = before[i]
            if j >= 0:
                r = rank((symbols[j], a))
                if r is not None:
                    push(heap, (r, j))
        return n - merges

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        get = self.cache.__getitem__
        total = len(parts) - 1
        for part in parts:
            if part:
                total += sum(map(get, unsplit_pieces(GPT_FAST, GPT_FULL, part)))
        return total


class WordEndCodec:
    """Encoder and decoder for the lower-casing vocabulary with word ends.

    ``leaf_chars``: the longest text that is split into words at one go.
    ``leaf_word``: the longest word that is merged at one go.
    ``threads``: leaves of one text that are encoded at a time, if it has ``MANY``
    at least; handing over fewer takes longer than they do.
    ``text_joins`` and ``word_joins`` count the joins that were made.
    """

    MANY = 32

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, leaf_word: int = LEAF_WORD, threads: int = 2):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = read_vocabulary(path)
        self.leaf_chars, self.leaf_word = max(8, leaf_chars), max(4, leaf_word)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self._path, self._tokenizer = path, Tokenizer.from_file(path)
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        self._split = pre_tokenizers.Split(Regex(splitter["pattern"]["Regex"]), splitter["behavior"].lower(), splitter["invert"])
        self._end = self._tokenizer.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        top = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * top
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.cache = Bounded(self._word)
        self.threads = threads
        self.text_joins = self.word_joins = 0

    @functools.cached_property
    def _pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(self.threads)

    def _leaves(self, encode, *parts) -> list:
        """Encodings of the leaves of one text, side by side."""
        return list((self._pool.map if self.threads > 1 and len(parts[0]) >= self.MANY else map)(encode, *parts))

    # words ---------------------------------------------------------------

    def _normal(self, text: str) -> tuple[str, bool]:
        """Normalised text, and if the fast pattern holds for it."""
        if not UNUSUAL.search(text):
            return text.lower(), True
        return self._tokenizer.normalizer.normalize_str(text), False

    def _scan(self, text: str, start: int, end: int, fast: bool) -> list[tuple[int, int]]:
        if fast:
            return [m.span() for m in WORD_FAST.finditer(text, start, end)]
        return [(start + a, start + b) for _, (a, b) in self._split.pre_tokenize_str(text[start:end])]

    def split_words(self, text: str, fast: bool) -> list[str]:
        """Words of a normalised text, by tree concatenation."""
        if not fast:
            return [text[a:b] for a, b in self._tree(text, lambda a, b: self._scan(text, a, b, False), lambda *x: self._join_words(text, *x, False))]
        return self._tree(text, lambda a, b: WORD_FAST.findall(text, a, b), lambda *x: self._join_plain(text, *x))

    def _tree(self, text: str, leaf, join) -> list:
        """Leaves of a text side by side, then neighbours joined pair by pair."""
        bounds = [*range(0, len(text), self.leaf_chars), len(text)]
        parts = self._leaves(leaf, bounds[:-1], bounds[1:])
        ends = bounds[1:]
        while len(parts) > 1:
            joined = [join(parts[k], parts[k + 1], ends[k], ends[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[2 * len(joined) :]
            ends = ends[1::2] + ends[2 * len(joined) :]
        return parts[0]

    def _join_plain(self, text: str, left: list[str], right: list[str], seam: int, end: int) -> list[str]:
        """Joins words without their places: those of a few at the seam are found again.

        Between words there are only blanks, so a word's place is the last one before
        the next word's, or the first one after the word before.
        """
        self.text_joins += 1
        size = 4
        while True:
            tail, head, at = [], [], seam
            for word in reversed(left[-size:]):
                at = text.rindex(word, 0, at)
                tail.append((at, at + len(word)))
            tail.reverse()
            at = seam
            for word in right[:size]:
                at = text.index(word, at) + len(word)
                head.append((at - len(word), at))
            whole_left, whole_right = len(tail) == len(left), len(head) == len(right)
            stop = end if whole_right or not head else head[-1][1]
            found = self._join_words(text, tail, head, seam, stop, True, whole_left, whole_right)
            if found is not None:
                return left[: len(left) - len(tail)] + [text[a:b] for a, b in found] + right[len(head) :]
            size *= 4

    def _join_words(self, text, left, right, seam, end, fast, whole_left=True, whole_right=True):
        """Spans of both sides joined; none if those of the sides that aren't whole don't reach far enough."""
        self.text_joins += not fast
        if not left or left[-1][1] <= seam - 3:
            return left + right
        if not right:
            return left[:-1] + self._scan(text, left[-1][0], end, fast)
        size = 4
        while True:
            # a window from a word start well inside the left half ...
            k = max(0, len(left) - size)
            while k > 0 and left[k][0] > seam - 3:
                k -= 1
            if left[k][0] > seam - 3 and not whole_left:
                return None
            # ... to a word end of the right half
            m = min(len(right), size)
            stop = end if m == len(right) else right[m - 1][1]
            window = self._scan(text, left[k][0], stop, fast)
            starts = {s: i for i, (s, e) in enumerate(right[:m])}
            for i, (s, e) in enumerate(window):
                # agreed: both start a word here, and end the same one before the edge
                if s in starts and right[starts[s]][1] == e and (e <= stop - 3 or (stop == end and whole_right)):
                    return left[:k] + window[:i] + right[starts[s] :]
            if stop == end:
                return left[:k] + window if whole_right else None
            size *= 4

    # tokens of one word --------------------------------------------------

    @functools.cached_property
    def _inner(self):
        """The merges without word ends, for pieces inside a word; few texts need them."""
        from tokenizers import Tokenizer

        spec = read_vocabulary(self._path)
        spec["model"]["end_of_word_suffix"] = None
        self._inner_tokenizer = Tokenizer.from_str(json.dumps(spec))
        return self._inner_tokenizer.model

    def _direct(self, word: str, last: bool) -> list[int]:
        return [t.id for t in (self._end if last else self._inner).tokenize(mapped(word))]

    def _lengths(self, ids: list[int]) -> list[int]:
        """UTF-8 bytes of each token."""
        n = len(self.suffix)
        return [len(s) - n if (s := self.strings[i]).endswith(self.suffix) else len(s) for i in ids]

    def word_ids(self, word: str, last: bool = True) -> list[int]:
        """Token ids of one word, by tree concatenation beyond ``leaf_word``."""
        if len(word) <= self.leaf_word:
            return self._direct(word, last)
        parts = [word[i : i + self.leaf_word] for i in range(0, len(word), self.leaf_word)]
        raw = [p.encode() for p in parts]
        _ = self._inner  # made before the threads need it
        ids = self._leaves(self._direct, parts, [False] * (len(parts) - 1) + [last])
        while len(ids) > 1:
            joined, data = [], []
            for k in range(0, len(ids) - 1, 2):
                closes = last and k + 2 == len(ids)
                joined.append(self._join_tokens(raw[k], ids[k], raw[k + 1], ids[k + 1], closes))
                data.append(raw[k] + raw[k + 1])
            if len(ids) % 2:
                joined.append(ids[-1])
                data.append(raw[-1])
            ids, raw = joined, data
        return ids[0]

    def _join_tokens(self, a: bytes, left: list[int], b: bytes, right: list[int], last: bool) -> list[int]:
        self.word_joins += 1
        size = 4
        while True:
            tail, head = left[-size:], right[:size]
            i, j = len(left) - len(tail), len(head)
            begin = len(a) - sum(self._lengths(tail))
            stop = sum(self._lengths(head))
            # windows start and end between characters
            while i > 0 and a[begin] & 0xC0 == 0x80:
                i -= 1
                begin -= self._lengths([left[i]])[0]
            while j < len(right) and b[stop] & 0xC0 == 0x80:
                stop += self._lengths([right[j]])[0]
                j += 1
            whole_left, whole_right = i == 0, j == len(right)
            window = self._direct((a[begin:] + b[:stop]).decode(), last and whole_right)
            if (whole_left or window[0] == left[i]) and (whole_right or window[-1] == right[j - 1]) and (
                len(window) > 1 or (whole_left and whole_right)
            ):
                return left[:i] + window + right[j:]
            size *= 2

    def _word(self, word: str) -> bytes:
        return np.asarray(self.word_ids(word), "<u4").tobytes()

    # texts ---------------------------------------------------------------

    def _words(self, text: str | None):
        """Words of a text, special tokens among them, in order."""
        if not text:
            return
        for part in self.special_split.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield None, part
            elif part:
                normal, fast = self._normal(part)
                if fast and len(normal) <= self.leaf_chars:
                    yield WORD_FAST.findall(normal), None
                else:
                    yield self.split_words(normal, fast), None

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers; null: none."""
        get = self.cache.__getitem__
        out = []
        for words, special in self._words(text):
            if special is not None:
                out.append(np.asarray([self.special[special]], "<u4").tobytes())
            else:
                out.extend(map(get, words))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as the vocabulary has no decoder of its own."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def word_end_codec(path: str, leaf_chars: int = LEAF_CHARS, leaf_word: int = LEAF_WORD) -> WordEndCodec:
    """One codec for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEndCodec(path, leaf_chars, leaf_word)


@functools.lru_cache(maxsize=2)
def byte_level_counter(path: str) -> ByteLevelCounter:
    """One counter for each worker process."""
    return ByteLevelCounter(path)
