import math
import random
import struct
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from tidemill.llm import pieces as m
from tidemill.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def _field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number * 8) + varint(value) if isinstance(value, int) else varint(number * 8 + 2) + varint(len(value)) + value


def test_equals_the_library_on_odd_texts():
    library, model, rng = SentencePieceProcessor(model_file=PATH), m.Model(open(PATH, "rb").read()), random.Random(1)
    bits = [" ", "  ", "   ", "\n", "\t", "a", "the", "The.", "1999", "é", "中文", "\U0001f642", "▁", "<s>", "<0x0A>", "e", "ss", "tion", "http://", "...", "\x01", "ﬁ", "\xa0", "Ж", "дом"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), repr(text)
        assert model.decode(ids) == library.decode(library.encode(text)), repr(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_with_a_character_map_equals_the_library(rule):
    library, rng = SentencePieceNormalizer(rule_name=rule), random.Random(4)
    own = m.Normaliser(dict(m._fields(library.serialized_normalizer_spec())))
    assert bool(own.units) == (rule != "identity")
    bits = [" ", "  ", "\t", "\n", "a", "B", "Ｈｅ", "①", "ﬁ", "é", "e\u0301", "\u0301", "가", "\u1100\u1161", "ｶﾞ", "ß", "Σ", "\u200b", "\u3000", "\xa0", "中", "\U0001f642", "½", "\x07", "™", "ǆ"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert own(text) == library.normalize(text), repr(text)


def test_a_model_with_a_character_map_equals_the_library():
    """The pieces of the given file, with a map in place of its own normaliser."""
    data, rng = b"", random.Random(5)
    spec = SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    for number, value in m._fields(open(PATH, "rb").read()):
        if number != 4:  # the file's own checks of its normaliser
            data += _field(number, spec if number == 3 else value)
    library, model = SentencePieceProcessor(model_proto=data), m.Model(data)
    bits = [" ", "\t", "the", "Ｔｈｅ", "①", "ﬁne", "e\u0301", "½ ", "中", "ing", "\u3000"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text), repr(text)


def _changed(kinds=None, unigram=False, spec=None):
    """The given file with other kinds of some pieces; as a unigram file with scores that fall with a piece's number, slower and slower."""
    data, i = b"", 0
    for number, value in m._fields(open(PATH, "rb").read()):
        if number == 1:
            piece = dict(m._fields(value))
            kind = (kinds or {}).get(piece[1].decode(), piece.get(3, 1))
            score = struct.pack("<f", -math.log(10 + i)) if unigram else piece[2]
            value, i = _field(1, piece[1]) + b"\x15" + score + _field(3, kind), i + 1
        elif number == 2 and unigram:
            value = b"".join(_field(n, 1 if n == 3 else v) for n, v in m._fields(value) if not isinstance(v, bytes) or n not in (10, 15))
        elif number == 3 and spec:
            value = spec
        elif number == 4:
            continue
        data += _field(number, value)
    return data


def _same_as_library(data, texts):
    library, model = SentencePieceProcessor(model_proto=data), m.Model(data)
    for text in texts:
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text), repr(text)


def _texts(spark, seed):
    rng = random.Random(seed)
    bits = [" ", "  ", "an", "banana", "nation", "the", "ing", "Ｔｈｅ", "é", "\n", "ana", "a", "x", "中", "1999"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(1500)] + [r.text[:2000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]


def test_symbols_of_the_user_equal_the_library(spark):
    kinds = {"an": 4, "ing": 4, "ation": 4}
    _same_as_library(_changed(kinds), _texts(spark, 7))
    spec = SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    _same_as_library(_changed({"an": 4, "é": 4}, spec=spec), _texts(spark, 8))


def test_a_unigram_file_of_thousands_of_pieces_equals_the_library(spark):
    """Where two ways to cut weigh the same but for rounding the library's may differ; it mustn't weigh less."""
    for kinds in ({}, {"an": 4, "ing": 4, "ation": 4, "ion": 5, "the": 5}):
        data = _changed(kinds, unigram=True)
        library, model = SentencePieceProcessor(model_proto=data), m.Model(data)
        assert len(model.arcs) > 30_000 and not model.bpe
        texts, same = _texts(spark, 9), 0
        for text in texts:
            own, other = np.frombuffer(model.encode(text), "<u4").tolist(), library.encode(text)
            weigh = lambda ids: -sum(model.scores[i] if model.kinds[i] in (1, 4) else 0.0 for i in ids)
            same += own == other
            assert own == other or abs(weigh(own) - weigh(other)) < 1e-3 * (1 + abs(weigh(own))), repr(text)
        assert same > 0.98 * len(texts)


def test_what_is_refused():
    for kinds in ({"an": 5}, {"▁the": 4}):
        with pytest.raises(ValueError):
            m.Model(_changed(kinds))


def test_states_of_white_space():
    trim, keep = m.Spaces(True, True), m.Spaces(False, False)
    for text, one, other in (("", "", ""), (" ", "", "▁"), ("  a  b ", "▁a▁b", "▁▁a▁▁b▁"), ("a b", "▁a▁b", "a▁b"), ("\t a", "▁\t▁a", "\t▁a")):
        assert trim(text) == one and keep(text) == other


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(m, "MEMORY", 1 << 19)
    monkeypatch.setattr(m, "PATHS", 1 << 19)
    model, rng = m.Model(open(PATH, "rb").read()), random.Random(6)
    for _ in range(300):
        model.encode(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 8, 100]))) for _ in range(20)))
        model.encode("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)))
    for memo in (model.weights, model.states, model.paths):
        assert memo.used <= 1.1 * (1 << 18) and all(sum(map(len, k)) <= 64 for k in [*memo.new, *memo.old])


def test_unigram_shortest_path():
    rows = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -5.0, 1), ("▁a", -4.0, 1), ("▁ab", -9.5, 1), ("ba", -4.2, 1)]
    data = b"".join(_field(1, _field(1, n.encode()) + b"\x15" + struct.pack("<f", s) + _field(3, k)) for n, s, k in rows)
    model = m.Model(data + _field(2, _field(3, 1)) + _field(3, _field(3, 1) + _field(4, 0)))
    rng = random.Random(2)

    def best(text):
        """Every way to cut the text."""
        if not text:
            return 0.0
        return min([best(text[len(n) :]) - s for n, s, k in rows if k == 1 and text.startswith(n)] or [1e9])

    for _ in range(60):
        text = model.normalise("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))))
        path = model.path(text)
        assert abs(sum(-model.scores[i] for i in path) - best(text)) < 1e-4 and "".join(model.names[i] for i in path) == text
    assert model.path("▁aZ") == [5, 0]


def test_query_and_cases(spark):
    library = SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = library.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(want), crc32(np.array(want, "<u4").tobytes()), True)
        assert r.n_byte_pieces == sum(map(library.is_byte, want)) and r.decoded_crc32 == crc32(docs[r.doc_id].encode())
    df = spark.createDataFrame([(1, None), (1, ""), (None, " x"), (2, "ab" * 100_000)], "doc_id int, text string").selectExpr("*", "1 AS ids", "2 AS n_pieces")
    got = m.encode(df, PATH, with_ids=True)
    assert [r.n_pieces for r in got.collect()][:2] == [0, 0]
    assert [r.text for r in m.decode(got, PATH).collect()] == ["", "", " x", "ab" * 100_000]
    assert m.encode(df.limit(0), PATH).count() == 0


def test_bytes_of_one_line_of_ascii_are_counted(spark):
    library = SentencePieceProcessor(model_file=PATH)
    texts = ["a\tb\tc", "\0", "one line\r", "no such character ~!@#^", "\x7f"]
    want = [sum(map(library.is_byte, library.encode(t))) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.n_byte_pieces for r in m.encode(df, PATH).orderBy("doc_id").collect()] == want and want[0] == 2
