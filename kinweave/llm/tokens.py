"""Fast exact encoding with the tokenizers library: each distinct unit of text between spaces is encoded once per worker.

A unit is a stretch of text that the tokenizer's own pre-tokenizer can never join with its neighbours, so the ids of a text
are the ids of its units one after another. Texts for which that is not plain to see go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Bound on the units remembered by a worker: about 200 bytes each.
MOST_UNITS = 600_000
#: Units longer than this are encoded but not remembered.
LONGEST_UNIT = 64

_loaded: dict = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, without truncation and padding, once per worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


#: The published byte-to-character rule of byte-level vocabularies: printable bytes stand for themselves, the rest for 256 and on.
_PLAIN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

#: Words of ASCII and Latin-1 letters, which every normaliser and pre-tokenizer here keeps whole, and marks that follow a word as one piece.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?$%&*#)]}\"-"


class _Units(dict):
    """unit -> ids as bytes. Looking up a missing unit notes it and gives None; fill() then encodes those noted."""

    def __init__(self, tokenizer, dtype, prefix: str, lower: bool):
        super().__init__()
        self.tokenizer, self.dtype, self.prefix, self.lower = tokenizer, dtype, prefix, lower
        self.code, self.mark = "H" if dtype is np.uint16 else "I", prefix and BYTE_CHARS[ord(prefix)]
        self.noted: dict[str, None] = {}
        self.brief: dict[str, bytes] = {}  # of this batch only: what there was no room for

    def __missing__(self, unit: str) -> bytes | None:
        found = self.brief.get(unit)
        if found is None:
            self.noted[unit] = None
        return found

    def piece(self, text: str, prefix: str = "") -> bytes:
        """The ids of what the pre-tokenizer keeps whole, straight from the model; prefix is in the vocabulary's characters."""
        chars = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_CHARS)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(prefix + chars)]).tobytes()

    def ids(self, unit: str) -> bytes:
        core = unit.rstrip(_MARKS)
        if not _WORD.fullmatch(core):
            return np.array(self.tokenizer.encode(self.prefix + unit, add_special_tokens=False).ids, self.dtype).tobytes()
        if core == unit:
            return self.piece(core.lower() if self.lower else core, self.mark)
        found = self.get(core) or self.brief.get(core)
        if found is None:
            found = self.ids(core)
            self.keep(core, found)
        marks = unit[len(core) :]
        end = self.get(f"\n{marks}")
        if end is None:
            end = self.piece(marks)
            self.keep(f"\n{marks}", end)
        return found + end

    def keep(self, unit: str, ids: bytes) -> None:
        if len(self) < MOST_UNITS and len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        else:
            self.brief[unit] = ids

    def fill(self) -> None:
        """Encodes the units noted. They are remembered while there is room and if they are not long."""
        noted, self.noted = self.noted, {}
        for unit in noted:
            self.keep(unit, self.ids(unit))


class Encoder:
    """Encodes texts exactly as Tokenizer.encode(text, add_special_tokens=False) does.

    kind 'byte': byte-level pre-tokenizer with the space in front of a word; a text may be cut before a single space and around
    a single line end, if characters that are not white space lie on both sides. kind 'word': white space is dropped, so a text
    may be cut at every space and line end.
    """

    #: White space for which the cuts above are not plain.
    ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kind = "byte" if self.tokenizer.normalizer is None else "word"
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.first = _Units(self.tokenizer, self.dtype, "", self.kind == "word")
        self.later = _Units(self.tokenizer, self.dtype, " ", False) if self.kind == "byte" else self.first
        self.line_end = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, self.dtype).tobytes()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        for units in (self.first, self.later):
            units.brief, units.noted = {}, {}
        parts = [self._parts(t) for t in texts]
        for units in (self.first, self.later):
            units.fill()
        return [np.frombuffer(self._joined(p), self.dtype) for p in parts]

    def _parts(self, text: str) -> list:
        """Per line: the units and their ids, None where missing. A text that may not be cut comes as its ids."""
        first, later = self.first, self.later
        if self.kind == "word":
            units = text.replace("\n", " ").split(" ") if text else []
            return [(units, [first[u] if u else b"" for u in units])]
        if not text:
            return []
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", "").isprintable() and self.ODD.search(text):
            return [([], [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()])]
        out = []
        for line in text.split("\n"):
            units = line.split(" ")
            ids = [first[units[0]]]
            ids += [later[u] for u in units[1:]]
            out.append((units, ids))
        return out

    def _joined(self, parts: list) -> bytes:
        lines = []
        for units, ids in parts:
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = self.later[units[i]] if i else self.first[units[i]]
            lines.append(b"".join(ids))
        return self.line_end.join(lines)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    key = ("encoder", path)
    if key not in _loaded:
        _loaded[key] = Encoder(path)
    return _loaded[key]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, by the published byte-to-character rule; special tokens stand for their text."""
    key = ("bytes", path)
    if key not in _loaded:
        back = {c: b for b, c in BYTE_CHARS.items()}
        made = load(path)
        out = [b""] * made.get_vocab_size(True)
        for token, at in made.get_vocab(True).items():
            out[at] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        _loaded[key] = out
    return _loaded[key]
