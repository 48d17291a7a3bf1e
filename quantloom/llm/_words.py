"""Pre-tokens and cached word encodings of the public tokenizer files."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: a path as it is, else a name that ``public_tokenizers`` knows."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), White_Space, other."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    # fixed values: Unicode's White_Space
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(codes: np.ndarray, kinds: np.ndarray, begin: np.ndarray) -> None:
    """An apostrophe that begins a pre-token takes a following s t m d re ve ll with it."""
    for i in np.flatnonzero(codes[:-1] == 39).tolist():
        if begin[i] and kinds[i + 1] == LETTER:
            tail = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
            n = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
            if n:
                begin[i + 1] = False
                if i + 1 + n < len(begin):
                    begin[i + 1 + n] = True


def spaced_starts(text: str) -> np.ndarray:
    """Where the pre-tokens of a byte-level tokenizer start: a single blank before a word belongs to it."""
    codes = codes_of(text)
    if not len(codes):
        return np.zeros(0, np.int64)
    kinds = _classes()[codes]
    begin = np.ones(len(codes), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
    space = kinds == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:])  # the last of a run of white space, a word follows
    begin[last] = True
    begin[last[codes[last] == 32] + 1] = False
    _contractions(codes, kinds, begin)
    return np.flatnonzero(begin)


def spaced_words(text: str) -> list[str]:
    at = spaced_starts(text).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]


def plain_words(text: str) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of a tokenizer that drops white space and takes digits one by one, and how many blanks
    stand before each."""
    codes = codes_of(text)
    if not len(codes):
        return [], np.zeros(0, np.int64)
    kinds = _classes()[codes]
    begin = np.ones(len(codes), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
    begin |= kinds == NUMBER
    _contractions(codes, kinds, begin)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(codes))
    word = kinds[starts] != SPACE
    starts = starts[word]
    return [text[a:b] for a, b in zip(starts.tolist(), ends[word].tolist())], np.cumsum(codes == 32)[starts]


def blocks(text: str, limit: int = 1 << 20):
    """A text in parts of about ``limit`` characters, cut only before a blank or line end that follows a word:
    no pre-token crosses such a place, so parts are encoded alone."""
    at = 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def lowered(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class _Numbers(dict):
    """Numbers words as they turn up; ``new`` has those that are still to be learned."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Encodes texts as the word-end BPE file does.

    ASCII blanks always part pre-tokens, so a text falls into raw words whose encodings don't depend on each
    other.  Two caches keep the ids of raw words and of the pre-tokens inside them; the library encodes each
    distinct pre-token once.  A full cache starts anew, which bounds its memory.  Strings of special tokens
    inside a text become their ids, as the library's default has it.
    """

    def __init__(self, file: str, most_raw: int = 350_000, most_words: int = 200_000):
        from tokenizers import Tokenizer, normalizers

        self.raw = Tokenizer.from_file(tokenizer_path(file))
        self.raw.no_padding()
        self.raw.no_truncation()
        self.raw.normalizer = normalizers.Sequence([])  # words come here lower-cased
        self.specials = {t.content: i for i, t in self.raw.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.special_bytes = re.compile(b"|".join(re.escape(s.encode()) for s in self.specials)) if self.specials else None
        self.tokens = [self.raw.id_to_token(i) or "" for i in range(self.raw.get_vocab_size())]
        self.is_end = np.array([t.endswith("</w>") for t in self.tokens])
        self.most_raw, self.most_words = most_raw, most_words
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def release(self) -> None:
        self.words = {}
        self._clear()

    def _learn_words(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = self.raw.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a word that stands differently among others
                self.words.update((w, np.array(self.raw.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()) for w in part)
                continue
            ends, packed = (4 * ends).tolist(), np.array(ids, np.uint32).tobytes()
            self.words.update((w, packed[a:b]) for w, a, b in zip(part, [0, *ends], ends))

    def _learn(self, raws: list[bytes]) -> None:
        if len(self.words) > self.most_words:
            self.words = {}
        texts = [r.decode("utf-8", "surrogatepass") for r in raws]
        words, owner = plain_words(lowered(" ".join(texts)))
        missing = dict.fromkeys(w for w in words if w not in self.words)
        if missing:
            self._learn_words(list(missing))
        each = [self.words[w] for w in words]
        lengths = np.bincount(owner, [len(e) // 4 for e in each], len(raws)).astype(np.int64) if words else np.zeros(len(raws), np.int64)
        ids = np.frombuffer(b"".join(each), np.uint32)
        n, have = len(raws), len(self.index) - len(raws)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while have + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[have : have + n], self.length[have : have + n] = np.cumsum(lengths) - lengths + self.used, lengths
        self.used += len(ids)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        counts = [0]
        for text in texts:
            words += text.split()
            counts.append(len(words))
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.index) > self.most_raw:
            self._clear()
        at = np.frombuffer(array("q", map(self.index.__getitem__, words)), np.int64)
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        n = self.length[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[counts]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (str or UTF-8 bytes), one after another, and where each text's begin, one more than texts."""
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        special = {k for k, t in enumerate(raw) if self.special_bytes and self.special_bytes.search(t)}
        if not special:
            return self._plain(raw)
        out: list[np.ndarray] = []
        for k, text in enumerate(raw):
            if k not in special:
                out.append(self._plain([text])[0])
                continue
            parts = self.split.split(text.decode("utf-8", "surrogatepass"))
            out.append(np.concatenate([np.array([self.specials[p]], np.uint32) if j % 2 else self._plain([p.encode("utf-8", "surrogatepass")])[0] for j, p in enumerate(parts)]))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives without a decoder: the tokens, a blank between them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@lru_cache(2)
def word_encoder(file: str) -> WordEncoder:
    """One encoder a Python worker; its cache serves all tasks that the worker runs."""
    return WordEncoder(file)
