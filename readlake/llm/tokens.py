"""Token ids of whole texts with a public word tokenizer, at the speed of a dictionary look-up for known words."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from readlake.llm.common import held, raw_values, slices, split_coded

#: Entries that a worker keeps of pieces that are several words, and of the tokenizer's own words; the first ones seen are the
#: frequent ones.
MOST_PIECES, MOST_WORDS = 100_000, 700_000
#: Bytes of texts that are looked up at once, and words that the model is given at once.
SLICE, MODEL_WORDS = 1 << 20, 5_000
# Printable ASCII and the precomposed Latin letters: lower-casing and composing them is the same one by one, so a piece of
# them is the same as its words.
_PLAIN = re.compile("[!-~À-ɏ]+")
# The commonest of these: one word.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
# A mark is a word of its own at the end of a piece, after one of these. Marks have places from 1 on.
MARKS = b".,;:!?"
_MARKS, _BEFORE = np.zeros(256, np.uint8), np.zeros(256, bool)
_MARKS[list(MARKS)] = range(1, len(MARKS) + 1)
_BEFORE[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
# The tokenizer's own pattern of words, over lower-cased text.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _marked(pieces: pa.Array) -> np.ndarray:
    """The place of the mark that ends each piece after a letter or digit; else 0."""
    if not len(pieces):
        return np.zeros(0, np.uint8)
    _, offsets, data = pieces.buffers()
    kind = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
    end = 3 + np.frombuffer(offsets, kind)[pieces.offset + 1 : pieces.offset + len(pieces) + 1]
    raw = np.concatenate([np.zeros(3, np.uint8), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)])
    size = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    last, one, two = raw[end - 1], raw[end - 2], raw[end - 3]
    # Latin letters of two bytes, but not the signs of times and division and the dotted I, which has no small letter of its own
    wide = (two >= 0xC3) & (two <= 0xC8) & (one >= 0x80) & (one < 0xC0) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))
    return np.where((size > 1) & _BEFORE[one] | (size > 2) & wide, _MARKS[last], 0)


class WordEncoder:
    """encode(text) gives the little-endian uint32 ids that the tokenizer gives for the whole text, encoded(texts) those of many.

    The tokenizer drops white space, so a text's ids are those of its pieces between ASCII white space. The distinct pieces
    of many texts, less a mark at their end, are looked up in a dictionary; unknown ones are cut into the tokenizer's
    words, and unknown words go to its model together, as lines that the words' last ids cut again. Pieces with anything but
    plain letters and signs go through the whole tokenizer.
    """

    def __init__(self, path: str, room: float = 1.0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # the model alone: words are given ready
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.most_pieces, self.most_words = int(room * MOST_PIECES), int(room * MOST_WORDS)
        self.known: dict[bytes, bytes] = {}
        self.several = 0  # known pieces that are not one word
        marks = [bytes([m]) for m in MARKS]
        found = self._words(marks)
        self.marks = pa.array([b"", *(found[m] for m in marks)], pa.binary())
        self.odd = re.compile(b"|".join(map(re.escape, self.special)) or b"(?!)")

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of lower-cased words of plain letters or signs."""
        out = {}
        for start in range(0, len(words), MODEL_WORDS):
            some = words[start : start + MODEL_WORDS]
            shown = [w.decode() if w.isascii() else "".join(map(self.letters.__getitem__, w)) for w in some]
            ids = np.array(self.model.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                flat, cut = ids.tobytes(), (ends * 4).tolist()
                out.update({w: flat[a:b] for w, a, b in zip(some, [0, *cut], cut, strict=False)})
            else:
                found = self.model.encode_batch_fast(shown, add_special_tokens=False)
                out.update({w: np.array(x.ids, "<u4").tobytes() for w, x in zip(some, found, strict=True)})
        return out

    def _learn(self, unknown: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the dictionary does not hold."""
        known, odd = self.known, []
        one = {p: p.lower() for p in unknown if p.isalpha()}
        several: dict[bytes, list[bytes]] = {}
        for piece in unknown - one.keys():
            text = piece.decode()
            if _WORD.fullmatch(text):
                one[piece] = text.lower().encode()
            elif _PLAIN.fullmatch(text) and not self.odd.search(piece):
                several[piece] = [w.encode() for w in _WORDS.findall(text.lower())]
            else:
                odd.append(piece)
        words = {*one.values(), *(w for cut in several.values() for w in cut)}
        found = self._words([w for w in words if w not in known])
        if len(known) - self.several + len(found) <= self.most_words:
            known.update(found)
        ids = lambda w: known[w] if (x := found.get(w)) is None else x
        rest = {piece: b"".join(map(ids, cut)) for piece, cut in several.items()}
        for piece, x in zip(odd, self.whole.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False), strict=True):
            rest[piece] = np.array(x.ids, "<u4").tobytes()
        if self.several + len(rest) <= self.most_pieces:
            known.update(rest)
            self.several += len(rest)
        return {piece: ids(w) for piece, w in one.items()} | rest

    def _slice(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of each text and `end`, as a binary array."""
        special = pc.match_substring(texts, "<|")  # the tokenizer lower-cases too; only its special tokens mind case
        low = pc.ascii_lower(texts)
        pieces, place, cuts = split_coded(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        mark = _marked(pieces)
        words = raw_values(pieces, mark > 0)
        found = list(map(self.known.get, words))
        unknown = [i for i, x in enumerate(found) if x is None]
        if unknown:
            new = self._learn({words[i] for i in unknown if words[i]})
            for i in unknown:
                found[i] = new.get(words[i], b"")
        ids = pc.binary_join_element_wise(pa.array(found, pa.binary()), self.marks.take(pa.array(mark)), b"")
        # the end follows every text like a piece
        ids = pa.concat_arrays([ids, pa.array([end], pa.binary())])
        laid = ids.take(pa.array(np.insert(place, cuts[1:], len(found))))
        _, offsets, data = laid.buffers()
        offsets = np.frombuffer(offsets, np.int32)[laid.offset + cuts + np.arange(len(cuts))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), data])

    def encoded(self, texts: pa.Array, end: bytes = b"") -> Iterator[tuple[int, int, pa.Array]]:
        """(start, stop, ids of each text and `end` as a binary array) of stretches of texts; a null text has the end alone."""
        for start, stop in slices(texts, SLICE):
            some = texts.slice(start, stop - start)
            if stop - start == 1 and (pc.binary_length(some)[0].as_py() or 0) > SLICE:
                yield start, stop, pa.array([self.encode(some.cast(pa.binary())[0].as_py()) + end], pa.binary())
            else:
                yield start, stop, self._slice(some, end)

    def encode(self, text: bytes | None) -> bytes:
        out, start, text = [], 0, text or b""
        while start < len(text):
            end = min(start + SLICE, len(text))
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            out.append(self._slice(pa.array([text[start:end]], pa.binary()).view(pa.string()), b"")[0].as_py())
            start = end
        return b"".join(out)


def encoder(path: str, room: float = 1.0) -> WordEncoder:
    """The worker's encoder for a tokenizer file; room: share of the entries that it may keep."""
    return held(("tokens", path, room), lambda: WordEncoder(path, room))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
