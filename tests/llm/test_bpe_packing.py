import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
CHARS = "ab c\n\r\t  é 'sdlTHE1²三!,.-_ \x1c 　"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(CHARS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encode_equals_the_library(library):
    own = bpe.codec(RANKS, P.PATTERN)
    for x in [*texts(3000), "a" * 50_000, "\n" * 500 + "x", "ab1" * 9000, "<|endoftext|>"]:
        assert own.encode(x) == library.encode_ordinary(x)
        assert own.decode(own.encode(x)) == x.encode()


def test_append_and_edit_keep_the_exact_encoding():
    own, r = bpe.codec(RANKS, P.PATTERN), random.Random(3)
    table = bpe.PrefixTable(own.pairs)
    data = b""
    for _ in range(60):
        more = "".join(r.choice("theraion ing") for _ in range(r.randint(0, 9))).encode()
        table.append(more)
        data += more
        assert table.ids() == bpe.PrefixTable(own.pairs, data).ids()
    for end in (0, 1, 17, len(data)):
        assert table.ids(end) == bpe.PrefixTable(own.pairs, data[:end]).ids()
    for _ in range(40):
        start = r.randint(0, len(data))
        stop = min(len(data), start + r.randint(0, 6))
        new = "".join(r.choice("abcthe ") for _ in range(r.randint(0, 6))).encode()
        table.replace(start, stop, new)
        data = data[:start] + new + data[stop:]
        assert bytes(table.data) == data and table.last == bpe.PrefixTable(own.pairs, data).last
    long = bpe.PrefixTable(own.pairs, b"thinking of the end " * 500)
    assert long.replace(5000, 5003, b"xyz") < 400  # near the edit only


def test_round_trip_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "twice the id", "x"), (3, "naïve café\n\n\nx  y", "x"), (4, "z" * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.round_trip(df, RANKS, P.PATTERN).collect()))
    want = []
    for k, x, _ in rows:
        ids = library.encode_ordinary(x or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("n_tokens", "IDS"), RANKS, P.PATTERN)


def check_pieces(rows, want, window=1024):
    """want: ids of each document in no order; every id in one piece, sequences gapless and never padded."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0
    assert by_doc.keys() == want.keys()
    for k, ids in want.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)


def test_packing(spark):
    tk = Tokenizer.from_file(JSON)
    r = random.Random(5)
    rows = [(k, x, k) for k, x in enumerate(texts(300, 7))]
    rows += [(900, None, 1), (901, "", 1), (902, "the end of it all\n" * 3000, 1), (903, "a <|endoftext|> b<|endoftext|><|endo", 1), (904, "a" + " " * 150_000 + "b", 1)]
    rows += [(1000 + k, " ".join(r.choice(["the", "of", "Éa", "x1."]) for _ in range(r.randint(1, 900))), 0) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    want = {k: [*tk.encode(x or "", add_special_tokens=False).ids, 0] for k, x, _ in rows}
    check_pieces(packing.pack(df, JSON).collect(), want)
    check_pieces(packing.pack(df, JSON, window=64, open_windows=2).collect(), want, 64)
    assert packing.pack(df.limit(0), JSON).collect() == []
    with_ids = packing.pack(df, JSON, with_ids=True).collect()
    assert sum(len(x.ids) for x in with_ids) == sum(map(len, want.values()))


def test_special_strings_are_their_tokens(spark):
    tk = Tokenizer.from_file(JSON)
    own = packing.Tokens(JSON)
    assert own.core is not None
    ids = lambda x, t=own: np.frombuffer(t.ids(x), "<u4").tolist()
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275, 0]
    plain = packing.Tokens(JSON, plain_specials=True)
    tk.encode_special_tokens = True
    assert ids("a <|endoftext|> b", plain) == [*tk.encode("a <|endoftext|> b", add_special_tokens=False).ids, 0]


def test_fast_ids_equal_the_library_on_all_characters():
    """Every 37th character and all below U+3000, each among letters, digits, blanks and line ends."""
    tk, own = Tokenizer.from_file(JSON), packing.Tokens(JSON)
    chars = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        x = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b.{chr(c)}\n{chr(c)}" for c in chars[at : at + 4096])
        assert own.ids(x) == np.array([*tk.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()
    for x in texts(4000, 11):
        assert own.ids(x) == np.array([*tk.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_keys_beside_nulls_stay_whole(spark):
    df = spark.createDataFrame([(2**60 + 1, "a"), (2**60 + 3, "b"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(df, JSON).collect()} == {2**60 + 1, 2**60 + 3, None}


def test_ids_against_the_order_of_the_merges_go_to_the_library(tmp_path):
    letters = sorted(packing._bytes_of_letters())
    rest = ["ab", "bc", "abc", "aa", "aaa"]
    for name, merges, vocab in (
        ("reversed", [("b", "c"), ("a", "b"), ("a", "bc"), ("a", "a"), ("aa", "a")], {x: 256 + k for k, x in enumerate(rest)}),
        ("twice", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("a", "a"), ("aa", "a")], {x: 256 + k for k, x in enumerate(rest)}),
        ("in order", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "a")], {x: 256 + k for k, x in enumerate(rest)}),
        ("a byte is missing", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "a")], {"z": -1} | {x: 256 + k for k, x in enumerate(rest)}),
    ):
        vocab = {x: k for k, x in enumerate(letters)} | vocab
        vocab = {x: k for x, k in vocab.items() if k >= 0}
        own = Tokenizer(BPE(vocab=vocab, merges=merges))
        own.pre_tokenizer = ByteLevel(add_prefix_space=False)
        own.save(str(tmp_path / "t.json"))
        ids = packing.Tokens(str(tmp_path / "t.json"))
        assert (ids.core is not None) == (name == "in order")
        r = random.Random(4)
        for x in ["abc", "bc", *("".join(r.choice("aabbcy ") for _ in range(r.randrange(12))) for _ in range(300))]:
            assert np.frombuffer(ids.ids(x), "<u4").tolist() == [*own.encode(x, add_special_tokens=False).ids, 0], (name, x)
