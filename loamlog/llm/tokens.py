"""Token ids of whole texts by a given tokenizer file, with a memory of pieces.

Both kinds of tokenizer files used here cut a text into pieces before they merge, and no
piece reaches from a sign that is not white space over white space. A text can therefore be
encoded as the pieces between such places, each distinct piece once: most of a corpus is
looked up. The places are found on the bytes of a whole batch, and Arrow numbers the pieces
between them, so that Python meets each distinct piece of a batch once.
ASCII signs are cut by the file's own rule, which for ASCII is the same in every regular
expression library; beside any other sign only white space cuts. Texts with white space
beyond ASCII (Unicode's own list, written out because Python's ``\\s`` has more) are cut one by one.
The strings of the file's added tokens are that token wherever a text holds them, as in the
tokenizers library; they part the text before anything else. Null texts count as empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_at_space = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
# The rules of the two kinds of files, with ASCII's letters, digits and space.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ENDINGS = [form[1:].encode() for form in _SHORT.split("|")]
_BYTE_LEVEL = re.compile(
    rf"{_SHORT}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
).findall
_LOWER_WORDS = re.compile(rf"{_SHORT}|[a-z]+|[0-9]|[^\t-\r 0-9a-z]+").findall
# Letters by every version of Unicode, composed, whose small forms are single letters.
_WORD = re.compile(
    "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f"
    "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+"
).fullmatch


def _byte_signs() -> dict[int, str]:
    """How byte-level files write bytes: visible Latin-1 as it is, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


_AS_SIGNS = _byte_signs()
_LOWER_RULE = rf"{_SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
#: Bytes that a generation of remembered pieces may take; a worker process keeps two.
REMEMBERED = 40 << 20
#: What Python itself takes for a remembered piece, about.
_OVERHEAD = 150
#: Bytes of texts looked up at a time.
_SLAB = 1 << 22

# Kinds of bytes, in the order that the comparisons below need.
_WHITE, _BLANK, _LETTER, _DIGIT, _OTHER, _BEYOND = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[9:14], _KINDS[32], _KINDS[128:] = _WHITE, _BLANK, _BEYOND
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cuts(signs: np.ndarray, starts: np.ndarray, lower: bool) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at ``starts``.

    ``lower``: the rule of the lower-case files, with single digits and without white space; its
    pieces may carry the blank before them, which their rule drops.
    """
    kinds = _KINDS[signs]
    first = np.zeros(len(signs) + 1, bool)  # of a text; one more at the end
    first[starts] = first[-1] = True
    before = np.empty_like(kinds)
    before[0], before[1:] = _WHITE, kinds[:-1]
    white, after_white = kinds <= _BLANK, before <= _BLANK
    cut = kinds != before
    if lower:
        cut |= kinds == _DIGIT
    # The last sign of a run of white space goes with the word after it, if it is a blank.
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~first[1:]
    cut = np.where(white, ~after_white | last, np.where(after_white, before == _WHITE, cut))
    cut |= first[:-1]
    _cut_short_forms(signs, kinds, before, first, cut, lower)
    if kinds.max(initial=0) == _BEYOND:
        # No cut beside a sign beyond ASCII, whose kind is not known here, nor after an
        # apostrophe that follows one: whether a short form begins there is not known either.
        own = first[:-1] | white | after_white
        beside = (kinds == _BEYOND) | (before == _BEYOND)
        after_sign = np.flatnonzero((signs == ord("'")) & (before == _BEYOND)) + 1
        beside[after_sign[after_sign < len(signs)]] = True
        cut &= own | ~beside
    return np.flatnonzero(cut)


def _cut_short_forms(signs, kinds, before, first, cut, lower) -> None:
    """An apostrophe that begins a piece takes one of the fixed endings with it, and no more."""
    begin = (before == _LETTER) | (before == _DIGIT) | (before == _WHITE) | first[:-1]
    if lower:
        begin |= before == _BLANK
    at = np.flatnonzero((signs == ord("'")) & begin)
    for ending in _ENDINGS:
        own = at[at + len(ending) < len(signs)]
        for i, sign in enumerate(ending, 1):
            own = own[(signs[own + i] == sign) & ~first[own + i]]
        for i in range(1, len(ending) + 1):
            cut[own + i] = False
        after = own + len(ending) + 1
        after = after[after < len(signs)]
        cut[after[kinds[after] == _LETTER]] = True


class Encoder:
    """``encode`` turns an array of texts into an array of ids for each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        added = self._tokenizer.get_added_tokens_decoder().values()
        # Longer strings first: of two that begin at one place the longer is meant.
        self._added = sorted((t.content for t in added), key=len, reverse=True)
        self._at_added = re.compile(f"({'|'.join(map(re.escape, self._added))})").split
        #: Whether all are found in the text as it is, whatever stands beside them.
        self._literal = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        self._ascii = self._ascii_rule()
        self._ruled = self._literal and self._ascii is not _at_space
        self._merged = self._tokenizer.model.tokenize
        apart = [f"[{_SPACE[4:]}]", *map(re.escape, self._added)]
        #: Texts that are cut one by one.
        self._apart = "|".join(apart)
        self._recent: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._held = 0

    def _ascii_rule(self):
        """How an ASCII text is cut, read from the file; at white space if it has another rule."""
        file = json.loads(self._tokenizer.to_str())
        cut, before = file["pre_tokenizer"] or {}, file["normalizer"] or {}
        if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not before:
            return _BYTE_LEVEL
        rules = [c.get("pattern", {}).get("Regex") for c in cut.get("pretokenizers", [])]
        if rules[:1] == [_LOWER_RULE] and "Lowercase" in [n["type"] for n in before.get("normalizers", [])]:
            return lambda text: _LOWER_WORDS(text.lower())
        return _at_space

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self._literal:
            return [text]
        if any(a in text for a in self._added):
            parts = self._at_added(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._between(part))]
        return self._between(text)

    def _between(self, text: str) -> list[str]:
        """Pieces of a text without added tokens."""
        if text.isascii():
            return self._ascii(text)
        pieces: list[str] = []
        for part in _at_space(text):
            if part.isascii():
                pieces += self._ascii(part)
            else:
                pieces.append(part)
        return pieces

    def _ids_of(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids and their numbers; the whole tokenizer's way."""
        if not pieces:
            return [], []
        found = self._tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        places = np.array(found.word_ids, np.int64)
        return found.ids, np.bincount(places, minlength=len(pieces)).tolist()

    def _written(self, piece: str) -> str | None:
        """The form that the file's merges apply to; None if the whole tokenizer has to find it.

        A printable ASCII piece that the file's own rule cut, and a word of letters, need their
        merges alone.
        """
        if not self._ruled or piece in self._added:
            return None
        word = piece.strip(" ")
        if piece.isascii():
            if not piece.isprintable():
                return None
            return piece.replace(" ", _AS_SIGNS[32]) if self._ascii is _BYTE_LEVEL else word
        if len(piece) - len(word) > (piece[0] == " ") or not _WORD(word):
            return None
        own = piece if self._ascii is _BYTE_LEVEL else word.lower()
        return own.encode().decode("latin-1").translate(_AS_SIGNS)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The pieces' ids, as bytes of unsigned 32-bit numbers."""
        texts = [p.decode() for p in pieces]
        written = [self._written(t) for t in texts]
        found, numbers = self._ids_of([t for t, own in zip(texts, written) if own is None])
        found, numbers = iter(found), iter(numbers)
        ids: list[int] = []
        ends = []
        for own in written:
            if own is None:
                ids += islice(found, next(numbers))
            elif own:
                ids += [token.id for token in self._merged(own)]
            ends.append(4 * len(ids))
        raw = np.array(ids, np.uint32).tobytes()
        return [raw[low:high] for low, high in zip([0, *ends], ends)]

    def _remember(self, pieces: list[bytes], ids: list[bytes]) -> None:
        self._recent.update(zip(pieces, ids))
        self._held += sum(map(len, pieces)) + sum(map(len, ids)) + _OVERHEAD * len(ids)

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces. What was asked for since the last change of generations stays."""
        found = list(map(self._recent.get, pieces))
        missing = [p for p, ids in zip(pieces, found) if ids is None]
        if missing:
            old = list(map(self._older.get, missing))
            learned = iter(self._learn([p for p, ids in zip(missing, old) if ids is None]))
            own = [next(learned) if ids is None else ids for ids in old]
            self._remember(missing, own)
            fill = iter(own)
            found = [next(fill) if ids is None else ids for ids in found]
            if self._held > REMEMBERED:
                self._older, self._recent, self._held = self._recent, {}, 0
        return found

    def _joined(self, pieces: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts of so many pieces each."""
        if not len(counts):
            return []
        numbered = pieces.dictionary_encode()
        known = self._known(numbered.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(known), np.uint32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        slots = numbered.indices.to_numpy()
        size = sizes[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        shift = (np.cumsum(sizes) - sizes)[slots] - (ends - size)
        ids = ids[np.repeat(shift, size) + np.arange(total)]
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)][:-1])

    def _cut_together(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, and how many each has."""
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(places[0]), int(places[-1])
        if low == high:
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        signs = np.frombuffer(data, np.uint8)[low:high]
        lower = self._ascii is not _BYTE_LEVEL
        if lower:
            signs = _LOWER[signs]
        ends = places - low
        begins = _cuts(signs, ends[:-1][np.diff(ends) > 0], lower)
        offsets = np.append(begins, len(signs)).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(signs)]
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), buffers)
        return pieces, np.diff(np.searchsorted(begins, ends))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self._ruled:
            apart = pc.match_substring_regex(texts, self._apart).to_numpy(zero_copy_only=False)
        else:
            apart = np.ones(len(texts), bool)
        one_by_one = [self._pieces(t) for t in texts.filter(pa.array(apart)).to_pylist()]
        pieces = pa.array([p.encode() for own in one_by_one for p in own], pa.binary())
        singly = iter(self._joined(pieces, np.array([len(own) for own in one_by_one], np.int64)))
        together = iter(self._joined(*self._cut_together(texts.filter(pa.array(~apart)) if apart.any() else texts)))
        return [next(singly if own else together) for own in apart]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, path: str, end: int) -> Iterator[np.ndarray]:
    """Per text its ids and then ``end``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + _SLAB, "right")) - 1)
        for ids in encoder(path).encode(texts.slice(low, high - low)):
            yield np.append(ids, np.uint32(end))
        low = high
