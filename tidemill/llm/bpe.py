"""Token ids of whole texts by the tokenizers library, for byte-level BPE files.

Such a tokenizer cuts a text into short pieces by a fixed pattern and encodes
each on its own. A text is cut here at some of the same places, at its white
space, and the ids of what lies between are remembered, so that the library
encodes each distinct stretch once in a while and not each time. Texts with
characters whose class isn't certain, or with a special token's string, go
through the library whole.

Only stretches of at most ``SHORT`` characters are remembered, and only so many
that they stay within ``MEMORY`` bytes, so neither very many nor very long
stretches (text without spaces) fill a worker.
"""

from __future__ import annotations

import json
import os
import re
import struct
from operator import itemgetter

import numpy as np
import pyarrow as pa

MEMORY = 192 << 20  # bytes that a Python worker's remembered stretches may take, by a rough count
SHORT = 64
_COST = 200  # bytes of an entry without its characters and ids
_STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s")
_UNSURE = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the tokenizer
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A word of ASCII or Latin-1 letters and closing marks: the pattern cuts between the two and nowhere else.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False, memory: int = MEMORY) -> Encoder:
    """One for each file in a Python worker; ``plain``: special tokens' strings in texts are ordinary text."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, memory, plain)
    return _encoders[path, plain]


def _odd_space(text: str) -> bool:
    """Whether there is white space other than single spaces between words and one or two ends of line."""
    return any(s in text for s in ("  ", " \n", "\n ", "\n\n\n")) or text.endswith("\n\n") or _OTHER_SPACE.search(text) is not None


class Encoder(dict):
    """Maps a stretch to its ids. One that follows a space is a key without it; one that doesn't has a space after it there.

    Keys of at most SHORT characters are kept, in two generations of ``memory`` bytes together.
    """

    def __init__(self, path: str, memory: int = MEMORY, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ready = json.loads(self.library.to_str())["pre_tokenizer"] == plain and self.library.normalizer is None
        # The byte-level alphabet: what the library's own pre-tokenizer makes of a space and of each Latin-1 letter.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba"]
        self.alphabet = {ord(c): level.pre_tokenize_str(c)[0][0] for c in [" ", *letters]}
        self.space, self.model = self.alphabet[ord(" ")], self.library.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.older: dict[str, bytes] = {}
        self.half, self.used = memory // 2, 0

    def token_bytes(self) -> list[bytes]:
        """What each id stands for: the byte-level alphabet read backwards."""
        from tokenizers.pre_tokenizers import ByteLevel

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        if set(back) != set(ByteLevel.alphabet()):
            raise ValueError("another alphabet than the usual one")
        names = {i: t for t, i in self.library.get_vocab().items()}
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        return [added[i] if i in added else bytes(back[c] for c in names[i]) for i in range(len(names))]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in _UNSURE) or any(s in text for s in self.special) or not self.ready:
            return self._whole(text)
        if _odd_space(text):
            return b"".join([self[s[1:] if s[0] == " " and not s.isspace() else f"{s} "] for s in _STRETCH.findall(text)])
        parts = text.replace("\n", " \n").split(" ")
        parts[0] += " "
        return b"".join(itemgetter(*parts)(self)) if len(parts) > 1 else self[parts[0]]

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self._word(self.space + key) if key.isascii() and key.isalpha() else self._stretch(key)
        if len(key) <= SHORT:
            self[key] = value
            self.used += _COST + 2 * len(key) + len(value)
            if self.used > self.half:
                self.older, self.used = dict(self), 0
                self.clear()
        return value

    def _word(self, letters: str) -> bytes:
        """The ids of letters of the byte-level alphabet."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _stretch(self, key: str) -> bytes:
        if key[-1:] == " ":
            stretch = key[:-1]
        elif key[:1] == "\n":  # an end of line and what follows it
            return self["\n "] + self[key[1:] + " "]
        else:
            stretch = " " + key
        word = _WORD.fullmatch(stretch)
        if not word:
            return self._whole(stretch)
        if word[2]:
            first = word[1]
            return self[first[1:] if first[0] == " " else first + " "] + self[word[2] + " "]
        return self._word(stretch.translate(self.alphabet))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ids_column(texts: list[str], path: str, end: int) -> list[bytes]:
    """Each text's ids and the end id."""
    encode, tail = encoder(path).encode, np.array([end], "<u4").tobytes()
    return [encode(t) + tail for t in texts]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
