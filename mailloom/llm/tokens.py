"""Token ids of whole texts by a public tokenizer, piece by piece with a memory.

Both kinds of tokenizer cut a text into words and runs of letters, digits or signs
before they merge, so the ids of a text are the ids of its pieces in a row, and a piece
met before costs a lookup. Ids come from the tokenizer's own model; where a text or a word
holds anything but plain Latin text and single blanks, it goes through the tokenizer whole.
A piece is remembered from its second time on, and the memories are emptied when full.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from codecs import charmap_decode

MEMORY = 1_000_000
LONG = 60
SEEN_SLOTS = 1 << 23

# Blanks beyond ASCII, and the separators that Python alone takes for blanks.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_TWO_BLANKS = re.compile("[ \t\n\x0b\x0c\r][ \t\n\x0b\x0c\r]")
# Letters with one form in NFC and a lower case of one letter.
_PLAIN = re.compile("[\t-\r -~\xa1-įı-ɀ]*")
# How the two public tokenizers cut a text before merging.
_CUTS = {
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
# Byte-level tokenizers show each byte as a letter: itself where it can be printed, else the
# next of the letters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SHOWN_BYTES = "".join(_BYTES[b] for b in range(256))
# Signs that end a word, none of them a letter, digit or blank.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Before the first word of a text; before the place of a text taken whole. Both are in _ODD.
_HEAD, _TAKEN = "\x1c", "\x1d"
_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """`kind`: "word" for the tokenizer that drops blanks and case, "byte" for the one that
    keeps them."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(100_000, 20, 20)  # large dicts of strings hold no cycles
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cut = regex.compile(_CUTS[kind]).findall
        self.kind = kind
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.seen = bytearray(SEEN_SLOTS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _again(self, piece: str) -> bool:
        slot = hash(piece) & (SEEN_SLOTS - 1)
        met = self.seen[slot]
        self.seen[slot] = 1
        return met and len(piece) <= LONG

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", _BYTES[32])
        else:
            shown = piece.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if self._again(piece):
            self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        given = word if self.kind == "word" or word[:1] == "\n" else " " + word
        if not _PLAIN.fullmatch(given):
            return self.whole(given)
        pieces = self.cut(given.lower() if self.kind == "word" else given)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids of the text, in the byte order of the machine (little-endian)."""
        if not text:
            return b""
        if _ODD.search(text):
            return self.whole(text)
        first = b""
        if self.kind == "word":
            words = text.split()
        else:
            if _TWO_BLANKS.search(text):
                return self.whole(text)
            head, *words = text.replace("\n", " \n").split(" ")
            if head:
                first = self.whole(head)
        known = self.words
        new = set(words).difference(known)
        if not new:
            return first + b"".join([known[w] for w in words])
        if len(known) + len(self.pieces) > MEMORY:
            known.clear()
            self.pieces.clear()
            self.seen = bytearray(SEEN_SLOTS)
            new = set(words)
        learned = {w: self._word(w) for w in new}
        for w, ids in learned.items():
            if self._again(w):
                known[w] = ids
        return first + b"".join([known.get(w) or learned[w] for w in words])


def _has_odd(text: str) -> bool:
    """As a search for _ODD; none of those can be printed, so most texts need no search."""
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return not text.replace("\n", "").isprintable() and _ODD.search(text) is not None


def _is_letters(word: str) -> bool:
    """One piece of letters that a tokenizer takes as they are."""
    return word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word) is not None)


def _has_two_blanks(text: str) -> bool:
    """As a search for _TWO_BLANKS; by four pairs where spaces and line ends are all blanks."""
    if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        return _TWO_BLANKS.search(text) is not None
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


class _Words(dict):
    """Ids of words; one that is not here is asked of `learn`."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class ByteEncoder(Encoder):
    """The byte-level kind, whose words carry signs and case and so are met seldom.

    Texts come in groups, and each different word of a group is looked up once. A word is cut into
    letters, which are a word too, and the signs behind them; words of letters alone and words that
    need the tokenizer's own cuts are kept, so a memory of a size holds more of them. Both memories
    keep what is met once; when they are full they become the old ones, which stay for lookups
    until the next time, so frequent words are not learned anew.
    """

    def __init__(self, path: str):
        super().__init__(path, "byte")
        self.words = _Words(self._word)
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.taken: list[bytes] = []

    def _full(self) -> bool:
        return len(self.words) + len(self.pieces) >= MEMORY // 2

    def _merged(self, piece: str) -> bytes:
        shown = charmap_decode(piece.encode(), "strict", _SHOWN_BYTES)[0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.old_pieces.get(piece) or self._merged(piece)
        if len(piece) <= LONG and not self._full():
            self.pieces[piece] = ids
        return ids

    def _cut(self, given: str) -> bytes:
        if not _PLAIN.fullmatch(given):
            return self.whole(given)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in self.cut(given)])

    def _bare(self, word: str, line: str = "") -> bytes:
        """Ids of a word without a blank before it, or with the line end `line`."""
        letters = word.rstrip(_SIGNS)
        if not _is_letters(letters):
            return self._cut(line + word)
        parts = (line, letters, word[len(letters):])
        return b"".join([self.pieces.get(p) or self._piece(p) for p in parts if p])

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_SIGNS)
        if len(letters) < len(word) and _is_letters(letters):
            signs = word[len(letters):]
            return self.words[letters] + (self.pieces.get(signs) or self._piece(signs))
        if word[:1] == "\n":
            return self._bare(word[1:], "\n")
        if word[:1] == _HEAD:
            return self._bare(word[1:])
        if word[:1] == _TAKEN:
            return self.taken[int(word[1:])]
        ids = self.old_words.get(word)
        if ids is None:
            ids = self._merged(" " + word) if _is_letters(word) else self._cut(" " + word)
        if len(word) <= LONG and not self._full():
            self.words[word] = ids
        return ids

    def _marked(self, text: str) -> str:
        """The text as words with single blanks between, or the place of its ids in `taken`."""
        if self._full():
            self.old_words, self.old_pieces = self.words, self.pieces
            self.words, self.pieces = _Words(self._word), {}
        if _has_odd(text):
            self.taken.append(self.whole(text))
        elif _has_two_blanks(text):  # blanks in a row are pieces of their own
            self.taken.append(self._cut(text))
        else:
            return _HEAD + text.replace("\n", " \n")
        return f"{_TAKEN}{len(self.taken) - 1}"

    def all_ids(self, texts: list[str]):
        """Ids of the texts in a row as unsigned 32-bit numbers, and the number of each text's."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.taken = []
        split = pc.split_pattern(pa.array([self._marked(t) for t in texts], pa.large_string()), " ")
        places, words = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        at = words.indices.to_numpy()
        learned = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        self.taken = []
        sizes = np.fromiter(map(len, learned), "i8", len(learned)) // 4
        flat = np.frombuffer(b"".join(learned), "<u4")
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        # Each word's ids are copied from its place in `flat`.
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)
        source += np.arange(len(source), dtype="i4" if len(source) < 1 << 31 else "i8")
        return flat.take(source), np.diff(ends[places])

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0].tobytes()


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ByteEncoder(path) if kind == "byte" else Encoder(path, kind)
    return _ENCODERS[path, kind]
