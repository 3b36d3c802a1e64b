"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

Compiled from a model file: a normaliser, the pieces as arcs, and byte fallback
arcs for characters that no piece has. The normaliser is a transducer from
characters to characters: its arcs rewrite the longest source string of the file's
character map (if it has one), white space becomes U+2581, and two states, after a
space and not, take care of extra white space and the dummy prefix. Composed with a
text they give a lattice over the normalised characters, and the path of least
weight in the tropical semiring is the encoding.

Unigram models weigh an arc by minus its piece's score, and a symbol of the user's nothing. A BPE model's result isn't
a sum of scores; it is the one path on which every two neighbouring pieces are
what BPE makes of the two together. Those models have a further acceptor of pairs,
of weight 0 for such neighbours and infinite for others, so the path of finite
weight is found by the same search. One state a position is enough, as each prefix
has one such path.

In BPE models symbols of the user's are cut out before the lattice. Those with unused pieces, and symbols with spaces,
are an error.

A text falls into stretches at pairs of characters that stand together in no
piece; no arc crosses them. Paths of short stretches are remembered within a bound
of bytes.

Null text counts as empty and has no pieces. Repeated rows are rows of their own,
an empty table gives an empty result, other columns don't matter.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.shared import Memo, with_columns

SPACE = "▁"
MEMORY = 96 << 20  # bytes that a Python worker's memos of weights and of states may take each, by a rough count
PATHS = 224 << 20  # and that of stretches' paths, which saves the most
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_UNIGRAM, _BPE = 1, 2
_NO_PATH = float("inf")
State = tuple[float, int, str, int | None]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield number, data[at : at + size]
            at += size


class Spaces:
    """The transducer of white space, with a state after a space (and at the start) and one after another character.

    Arcs: (state, whether the character is a space) -> (next state, what is written before the character, whether it is
    written). Trimming, a space waits in its state until a character follows, so those after it, at the start and at the end
    write nothing; else each writes its mark. While no space follows another the arcs taken are those that write a mark for
    a space, and such stretches are rewritten at once.
    """

    START, AFTER, OTHER = "start", "after a space", "after another"

    def __init__(self, trim: bool, prefix: bool) -> None:
        self.trim, self.prefix = trim, prefix
        self.arcs = {
            (self.START, True): (self.START, "", False), (self.START, False): (self.OTHER, "", True), (self.AFTER, True): (self.AFTER, "", False),
            (self.AFTER, False): (self.OTHER, SPACE, True), (self.OTHER, True): (self.AFTER, "", False), (self.OTHER, False): (self.OTHER, "", True),
        }

    def __call__(self, text: str) -> str:
        if self.trim and ("  " in text or text[:1] == " " or text[-1:] == " "):
            state, out = self.START, []
            for part in re.findall(" |[^ ]+", text):  # characters that aren't spaces stay in one state together
                state, before, written = self.arcs[state, part == " "]
                out.append(before + part if written else before)
            text = "".join(out)
        else:
            text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text


class Normaliser:
    """The transducer of a file's normaliser: its character map (a double-array trie over UTF-8 and the strings it points to) and its flags."""

    def __init__(self, spec: dict[int, int | bytes]) -> None:
        self.prefix = bool(spec.get(3, 1))
        self.spaces = Spaces(bool(spec.get(4, 1)), self.prefix)
        self.kept: re.Pattern[str] | None = None  # symbols that no arc rewrites
        self.units, self.targets = array("I"), b""
        if data := spec.get(2):
            size = int.from_bytes(data[:4], "little")
            self.units.frombytes(data[4 : 4 + size])
            self.targets = data[4 + size :]
        self.single: dict[str, tuple[str, bool]] = {}

    def arc(self, data: bytes, at: int) -> tuple[int, str] | None:
        """The longest arc whose source begins there: where it ends and what it writes."""
        units, best = self.units, None
        place = self._offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                target = units[place] & 0x7FFFFFFF
                best = i + 1, self.targets[target : self.targets.index(0, target)].decode()
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def mapped(self, text: str) -> str:
        """The text rewritten by the character map."""
        if not self.units:
            return text
        if all(self._stays(c) for c in set(text)):
            return text
        data, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(data):
            arc = self.arc(data, at)
            if arc is None:  # the character stays
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                arc = at + n, data[at : at + n].decode()
            at = arc[0]
            out.append(arc[1])
        return "".join(out)

    def _stays(self, char: str) -> bool:
        """Whether no source begins with this character."""
        known = self.single.get(char)
        if known is None:
            if len(self.single) > 100_000:
                self.single.clear()
            place, data = self._offset(self.units[0]), char.encode("utf-8", "replace")
            known = True
            for byte in data:
                place ^= byte
                unit = self.units[place]
                if unit & 0x800000FF != byte:
                    break
                place ^= self._offset(unit)
            else:
                known = False
            self.single[char] = known
        return known

    def __call__(self, text: str) -> str:
        if self.kept and self.units:
            parts = self.kept.split(text)
            text = "".join([part if i % 2 else self.mapped(part) for i, part in enumerate(parts)])
        else:
            text = self.mapped(text)
        return self.spaces(text)


class Model:
    """The compiled transducers of a model file's bytes."""

    def __init__(self, data: bytes) -> None:
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kind = trainer.get(3, _UNIGRAM)
        if kind not in (_UNIGRAM, _BPE) or trainer.get(24, 0) or not normalizer.get(5, 1):
            raise ValueError("only unigram and BPE models, with escaped white space as a prefix")
        self.bpe = kind == _BPE
        users = sorted((n for n, k in zip(self.names, self.kinds, strict=True) if k == _USER), key=lambda n: (-len(n), n))
        if self.bpe and _UNUSED in self.kinds:
            raise ValueError("no BPE models with unused pieces: the library takes those apart by the order of all its merges")
        if any(SPACE in n or " " in n for n in users):
            raise ValueError("no symbols of the user's with spaces")
        self.normalise = Normaliser(normalizer)
        self.prefix = self.normalise.prefix
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes_ = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _BYTE}
        self.arcs = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _NORMAL or k == _USER and not self.bpe}
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == _NORMAL]
        if users and not self.bpe:  # in a unigram model such symbols weigh nothing
            for n in users:
                self.scores[self.arcs[n]] = 0.0
        # In a BPE model they are cut out before the lattice: the longest first, from the left.
        self.users = {n: struct.pack("<I", self.names.index(n)) for n in users}
        kept = re.compile(f"({'|'.join(map(re.escape, users))})") if users else None
        self.cut = kept if self.bpe else None
        self.normalise.kept = kept
        self.score_of = {n: self.scores[i] for n, i in self.arcs.items()}
        self.tails = {n[i:]: -1 for n in self.arcs for i in range(len(n))} | self.arcs  # -1: ends of pieces that are none themselves
        self.inside = {n[i : i + 2] for n in self.arcs for i in range(len(n) - 1)}
        self.fallback = 10 - min(normal, default=0.0)
        self.least = 0.0 if self.bpe else -_NO_PATH  # no path has less weight
        self.weights, self.states, self.paths = Memo(MEMORY), Memo(MEMORY, 48), Memo(PATHS)
        self.output = [bytes([int(n[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds, strict=True)]
        # A stretch can only begin at a space after something else if no piece has one inside.
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not any(p[1] == SPACE != p[0] for p in self.inside) else re.compile(".+", re.S)

    def merge(self, text: str) -> list[str]:
        """What BPE makes of a short text: the pair of best score first, the left one of equals."""
        score, none = self.score_of.get, -_NO_PATH
        parts = list(text)
        pairs = [score(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _weight(self, last: str, piece: str) -> float:
        """Of the arc of a piece after another; '' stands for the start and for characters that no piece has."""
        pair = (last, piece)
        found = self.weights.old.get(pair)
        if found is None:
            if not self.bpe:
                found = -self.scores[self.arcs[piece]]
            elif last and last + piece in self.arcs:  # two such neighbours become one
                found = _NO_PATH
            else:
                found = 0.0 if self.merge(last + piece) == ([last, piece] if last else [piece]) else _NO_PATH
        self.weights.put(pair, found, len(last) + len(piece))
        return found

    def _bytes_of(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def _at(self, text: str, i: int, states: list[State | None]) -> State:
        """The state after the first i characters, which may be remembered by them."""
        state = self.states.new.get(text[:i]) or self.states.old.get(text[:i])
        if state is None:  # forgotten meanwhile
            for j in range(1, i):
                states[j] = states[j] or self._state(text, j, states)
            state = self._state(text, i, states)
        states[i] = state
        return state

    def _state(self, text: str, j: int, states: list[State | None]) -> State:
        """The least weight of a path over the first j characters, and its last arc: where it starts, its piece and the piece's number."""
        tails, weights = self.tails.get, self.weights.new
        best: State = (_NO_PATH, j - 1, "", None)
        i = j - 1
        while i >= 0 and (number := tails(piece := text[i:j])) is not None:
            if number >= 0:
                cost, _, last, _ = states[i] or self._at(text, i, states)
                if cost < _NO_PATH:
                    weight = weights.get((last, piece))
                    if weight is None:
                        weight = self._weight(last, piece)
                    if cost + weight <= best[0] and weight < _NO_PATH:  # of equals the one with the longest last piece
                        best = (cost + weight, i, piece, number)
                        if best[0] <= self.least:
                            return best
            i -= 1
        if text[j - 1] not in self.arcs:
            cost = (states[j - 1] or self._at(text, j - 1, states))[0] + (0.0 if self.bpe else self.fallback)
            if cost < best[0]:
                best = (cost, j - 1, "", None)
        return best

    def path(self, text: str) -> list[int]:
        """Piece numbers on the path of least weight through the lattice of a stretch.

        States depend only on the characters before them; those of short stretches are remembered by their prefix.
        """
        n, start = len(text), 0
        states: list[State | None] = [(0.0, 0, "", None), *[None] * n]
        short = n <= self.states.longest
        if short:  # from the longest prefix that is remembered
            new, old, over = self.states.new, self.states.old, n
            while start < over:  # a remembered prefix's own prefixes are remembered, too, unless forgotten meanwhile
                half = (start + over + 1) // 2
                if text[:half] in new or text[:half] in old:
                    start = half
                else:
                    over = half - 1
        for j in range(start + 1, n + 1):
            states[j] = self._state(text, j, states)
            if short:
                self.states.put(text[:j], states[j], j)
        out, at = [], n
        while at:
            _, before, _, number = states[at] or self._at(text, at, states)
            out.append([number] if number is not None else self._bytes_of(text[before:at]))
            at = before
        return [x for part in reversed(out) for x in part]

    def _stretch(self, stretch: str) -> bytes:
        found = self.paths.old.get(stretch)
        if found is None:
            inside, part = self.inside, self._part
            cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in inside]
            if cuts:
                found = b"".join([part(stretch[i:j]) for i, j in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
            else:
                ids = self.path(stretch)
                found = struct.pack(f"<{len(ids)}I", *ids)
        self.paths.put(stretch, found, len(stretch), len(found))
        return found

    def _part(self, part: str) -> bytes:
        return self.paths.new.get(part) or self._stretch(part)

    def encode(self, text: str) -> bytes:
        """The text's piece numbers as little-endian unsigned 32-bit integers."""
        text = self.normalise(text)
        if self.cut:
            return b"".join([self.users[part] if i % 2 else self._lattices(part) for i, part in enumerate(self.cut.split(text))])
        return self._lattices(text)

    def _lattices(self, text: str) -> bytes:
        known = self.paths.new.get
        return b"".join([known(s) or self._stretch(s) for s in self.stretches.findall(text)])

    def decode(self, ids: bytes) -> str:
        """The text again; bytes that aren't UTF-8 become U+FFFD."""
        output = self.output
        text = b"".join([output[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_byte_pieces, decoded_crc32 (of the decoded text in UTF-8), round_trip (it equals the text), and ids if asked for.

    ``model_file`` is read once on the driver; its size is that of the vocabulary.
    """
    with open(model_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        model = _compiled(data.value)
        low, high = (min(model.bytes_.values()), max(model.bytes_.values())) if model.bytes_ else (0, -1)

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            rows = []
            for text in texts:
                ids = model.encode(text)
                back = model.decode(ids)
                numbers = np.frombuffer(ids, "<u4")
                n = int(((numbers >= low) & (numbers <= high)).sum())
                rows.append((len(numbers), crc32(ids), n, crc32(back.encode()), back == text, ids))
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

        return columns

    out = with_columns(docs, text_col, make, "n_pieces long, ids_crc32 long, n_byte_pieces long, decoded_crc32 long, round_trip boolean, ids binary", [F.col(id_col).alias("doc_id")])
    return out if with_ids else out.drop("ids")


_models: dict[int, Model] = {}


def _compiled(data: bytes) -> Model:
    """One for each file in a Python worker."""
    key = crc32(data)
    if key not in _models:
        _models[key] = Model(data)
        gc.freeze()  # the model stays, and memos hold no cycles: looking for some costs a fifth of the time
        gc.set_threshold(500_000, 20)
    return _models[key]


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of a column ``ids``; null ids give an empty text."""
    with open(model_file, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _compiled(data.value)
        for batch in batches:
            texts = [model.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, source.drop("ids").withColumn("text", F.lit("")).schema)
