"""Ids against the tokenizers library, packing invariants, exact round trips of the files."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamlog.llm import idfiles, packing, registry, tokens
from loamlog.llm.common import read_table

DIR = "/root/testdata/sf0.01"
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


#: Kinds of white space, combining marks, contractions, special tokens, anything else.
SIGNS = st.sampled_from(" \n\t\r\v\x1c\x1f\u2026\x85\xa0\u1680\u2003\u3000\u0338\u0301aB's3,\u00e9\u4e2d<|>") | st.characters(
    exclude_categories=["Cs"]
)


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plains():
    return {name: plain(name) for name in FILES}


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_same_ids(plains, name):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(SIGNS, max_size=40), max_size=4))
    def check(texts):
        found = list(tokens.encoded(pa.array(texts, pa.string()), public_tokenizers.path(name), 7))
        assert [f.tolist() for f in found] == [[*plains[name](t), 7] for t in texts]

    check()

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(" \n\t\v\x1caBsStTrevVmlLd'',.-!12") | st.characters(max_codepoint=127), max_size=60))
    def check_ascii(text):
        (found,) = tokens.encoded(pa.array([text], pa.string()), public_tokenizers.path(name), 7)
        assert found.tolist() == [*plains[name](text), 7]

    check_ascii()
    odd = ["<|endoftext|> a", "it's I'LL  we've", "a\n\n\n b", " \u0338x", "\x1c\x1c!a", None, ""]
    found = list(tokens.encoded(pa.array(odd, pa.string()), public_tokenizers.path(name), 7))
    assert [f.tolist() for f in found] == [[*plains[name](t), 7] for t in odd]


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_are_found_as_the_library_finds_them(plains, name):
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", " ", "\n", "a", "It's ", "\u00e9", "\u0301", "12"]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(added), max_size=9).map("".join), max_size=4))
    def check(texts):
        found = list(tokens.encoded(pa.array(texts, pa.string()), public_tokenizers.path(name), 7))
        assert [f.tolist() for f in found] == [[*plains[name](t), 7] for t in texts]

    check()
    (found,) = tokens.encoded(pa.array(["a <|endoftext|> b"], pa.string()), public_tokenizers.path(name), 7)
    assert found.tolist()[-3] == {FILES[0]: 50256, FILES[1]: 49407}[name]


def test_the_files_rules_are_known():
    assert tokens.Encoder(public_tokenizers.path(FILES[0]))._ascii is tokens._BYTE_LEVEL
    assert tokens.Encoder(public_tokenizers.path(FILES[1]))._ascii("It's") == ["it", "'s"]


def test_the_memory_is_bounded(plains, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own = tokens.Encoder(public_tokenizers.path(FILES[0]))
    for texts in (["a b c d e f"], ["a g", "h"], []):
        found = own.encode(pa.array(texts, pa.string()))
        assert [ids.tolist() for ids in found] == [plains[FILES[0]](t) for t in texts]
        assert not own._recent


def test_what_was_asked_for_stays_in_memory(monkeypatch):
    own = tokens.Encoder(public_tokenizers.path(FILES[0]))
    learned = []
    monkeypatch.setattr(own, "_learn", lambda pieces: learned.extend(pieces) or tokens.Encoder._learn(own, pieces))
    monkeypatch.setattr(tokens, "REMEMBERED", 10 * (tokens._OVERHEAD + 7))
    for turn in range(40):
        own.encode(pa.array([f"often {turn} kept", " often"]))
    assert learned.count(b"often") == learned.count(b" kept") == 1
    assert len(own._recent) + len(own._older) < 30


@pytest.mark.parametrize("name", FILES)
def test_slices_and_long_texts(plains, name):
    texts = ["a b", None, "", "it's  x\u00e9's 12", "y " * 3_000_000, "\u2026's it", "z'", "s"]
    array = pa.array(["first", *texts], pa.string()).slice(1)
    found = list(tokens.encoded(array, public_tokenizers.path(name), 7))
    assert [f.tolist() for f in found] == [[*plains[name](t), 7] for t in texts]


def whole(rows, length):
    """Check the pieces and return the ids of each document row, and the sequences' fills."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
    return by_doc, [sum(r["length"] for r in p) for p in by_sequence.values()]


def test_packing_of_the_given_documents(spark, plains):
    rows = registry.queries()["op3_packing"](spark, DIR).collect()
    by_doc, fills = whole(rows, 1024)
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, DIR, "documents").collect()}
    assert set(by_doc) == set(texts)
    for name, pieces in by_doc.items():
        ids = np.array([*plains[FILES[0]](texts[name]), 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert len(fills) * 1024 <= 1.01 * sum(fills) + 1024


def test_levels_follow_the_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(16, 1000)
    for row in range(400):
        before = packer.levels.copy()
        size = int(rng.integers(1, 16))
        options = {}
        for level in [0, *np.flatnonzero(before)]:
            if level + size <= 16:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 16:
                    after[level + size] += 1
                options[level] = int((after**2).sum())
        packer.add(row, np.arange(size))
        assert int((packer.levels**2).sum()) == min(options.values())
    packer.close()
    assert sum(len(p[2]) for w in packer.done for p in w) == sum(
        len(ids) for w in packer.done for _, _, ids in w
    )


def test_few_windows_stay_open():
    packer = packing.Packer(100, 20)
    for row in range(1000):
        packer.add(row, np.arange(60))
        assert packer.levels.sum() <= 20
    packer.close()
    assert len(packer.done) <= 630


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=80)), np.uint32)
    payload = idfiles.pack(ids, bits)
    assert len(payload) == (len(ids) * bits + 7) // 8
    low = data.draw(st.integers(0, len(ids)))
    assert idfiles.unpack(payload, bits, low, len(ids)).tolist() == ids[low:].tolist()
    assert idfiles.unpack(idfiles.pack(np.resize(ids, 20_000) if len(ids) else ids, bits), bits, 0, 0).tolist() == []


def test_long_blocks_round_trip():
    ids = np.arange(50_000, dtype=np.uint32)
    payload = idfiles.pack(ids, 17)
    assert np.array_equal(idfiles.unpack(payload, 17, 12_345, 50_000), ids[12_345:])


def test_files_of_the_given_documents(spark, plains):
    rows = {r["doc_id"]: r for r in registry.queries()["op7_id_files"](spark, DIR).collect()}
    start = 0
    for r in read_table(spark, DIR, "documents").orderBy("doc_id").collect():
        ids = np.array([*plains[FILES[1]](r["text"]), 1], "<u4")
        found = rows.pop(r["doc_id"])
        assert (found["start"], found["n_tokens"], found["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not rows


ODD = [(3, None), (None, ""), (None, "b"), (1, "a a"), (1, "a a"), (1, "z"), (2, "word " * 200_000)]


def test_odd_rows(spark, plains, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id int, text string, start int, ids string")
    path = public_tokenizers.path(FILES[0])
    pieces = packing.pack_documents(frame, path).collect()
    _, fills = whole(pieces, 1024)
    assert sum(fills) == sum(len(plains[FILES[0]](t)) + 1 for _, t in ODD)
    idfiles.write_ids(frame, str(tmp_path / "a"), path, 0, block=8)
    found = idfiles.documents_of(idfiles.read_blocks(spark, str(tmp_path / "a"))).collect()
    ids = {r["start"]: (r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found}
    stored = [ids[k] for k in sorted(ids)]
    expected = [(i, [*plains[FILES[0]](t), 0]) for i, t in ODD]
    assert sorted(map(str, stored)) == sorted(map(str, expected))
    assert [i for i, _ in stored] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    assert np.cumsum([0, *(len(x) for _, x in stored)])[:-1].tolist() == sorted(ids)


def test_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    path = public_tokenizers.path(FILES[0])
    assert packing.pack_documents(frame, path).collect() == []
    idfiles.write_ids(frame, str(tmp_path / "a"), path, 0)
    assert idfiles.documents_of(idfiles.read_blocks(spark, str(tmp_path / "a"))).collect() == []
