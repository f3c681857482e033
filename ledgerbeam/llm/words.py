"""Fast exact tokenising: chunks that a tokenizer treats apart are encoded once each."""

from __future__ import annotations

from array import array
from functools import cache

import regex

MOST_CHUNKS, MOST_WORDS = 120_000, 120_000  # remembered by generation; a worker keeps two
LONGEST_REMEMBERED = 48  # longer chunks are encoded each time, so memory stays bounded

# How the vocabulary's own file describes the split into pre-tokens.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

# Printable characters up to Latin Extended-B. For these NFC changes nothing, lower case
# does not depend on neighbours, and none is white space.
_PLAIN = regex.compile("[!-~¡-ɏ]+")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered:
    """A bounded memory of two generations: when the young one is full, the old is dropped."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def put(self, key: str, value: bytes) -> None:
        if len(key) > LONGEST_REMEMBERED:
            return
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class WordEncoder:
    """Ids of a lower-casing BPE tokenizer that drops white space.

    Such a tokenizer never joins what stands on two sides of a space, so a text's ids are
    those of its space-separated chunks in a row. Chunks repeat a lot, and each is encoded
    once and remembered. Only space, tab and line ends separate here, a subset of what the
    tokenizer drops; other white space is left to it, inside the chunk. Chunks of plain
    characters are split as the vocabulary's file says and merged by its model; all others,
    and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_chars = _byte_chars()
        self.chunks, self.pre_tokens = Remembered(MOST_CHUNKS), Remembered(MOST_WORDS)

    def _pre_token(self, word: str) -> bytes:
        memory = self.pre_tokens
        found = memory.young.get(word)
        if found is None:
            found = memory.old.get(word)
            if found is None:
                spelt = word
                if not word.isascii():
                    spelt = "".join([self.byte_chars[b] for b in word.encode()])
                found = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            memory.put(word, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.old.get(chunk)
        if found is None:
            plain = chunk.isascii() and chunk.isprintable() or _PLAIN.fullmatch(chunk)
            word = chunk.lower()
            if plain and word.isalpha():
                found = self._pre_token(word)
            elif plain and word[-1] in ".,;:!?" and word[:-1].isalpha():
                found = self._pre_token(word[:-1]) + self._pre_token(word[-1])
            elif plain and "<|" not in chunk:
                found = b"".join([self._pre_token(w) for w in PRE_TOKENS.findall(word)])
            else:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
                found = array("I", ids).tobytes()
        self.chunks.put(chunk, found)
        return found

    def ids(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers (little-endian, as is every machine
        that Spark runs on today)."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        known, chunk = self.chunks.young.get, self._chunk
        return b"".join([known(c) or chunk(c) for c in text.split(" ") if c])


@cache
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker and file; ``path`` is a file that every executor has."""
    return WordEncoder(path)
