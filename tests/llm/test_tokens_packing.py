import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.packing import cut_document, differencing, pack_documents, windows_of
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.rangecoder import class_counts, decode_blocks, encode_blocks
from gridloom.llm.tokenfile import pack_file, read_token_files, unpack_file, write_token_files
from gridloom.llm.tokens import TokenEncoder

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ENCODERS = [(TokenEncoder(WORD, True), "word"), (TokenEncoder(BYTE, False), "byte")]
TEXTS = [None, "", " ", "a", "Hello,  world!\n\nIt's fine. ", "é́ ñ ß ΣΑΣ", "\x1c a\x1cb \x0b", "a" * 5000, "x\t y \r\n z", "日本語 テキスト  混合", "tab\tand space"]


def direct(enc, text):
    return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9.,'\n\t \x1céß́日😀 "), max_size=60))
def test_parts_give_the_ids_of_the_whole_text(text):
    for enc, _ in ENCODERS:
        assert enc.encode(text) == direct(enc, text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=300), max_size=6), st.integers(41, 60_000))
def test_range_coder_round_trip(blocks, n_ids):
    data = [np.array(b, dtype=np.int32) for b in blocks]
    prior = class_counts(np.bincount(np.concatenate([*data, np.zeros(1, dtype=np.int32)]), minlength=n_ids))
    back = decode_blocks(encode_blocks(data, n_ids, prior), [len(b) for b in data], n_ids, prior)
    assert [b.tolist() for b in back] == blocks


def test_coder_saves_space():
    ids = np.random.default_rng(0).zipf(1.5, 200_000) % 3000
    data = pack_file(ids.astype("<u4"), [1], [len(ids)])
    assert len(data) < 2 * len(ids) and (unpack_file(data)[0] == ids).all()
    broken = bytearray(data)
    broken[-4000] ^= 255
    with pytest.raises(Exception):  # noqa: B017  (a checksum, or ids that run out)
        unpack_file(bytes(broken))


def test_token_files(spark):
    df = spark.createDataFrame([(10 - i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "n", "c"), (3, "dup", "c"), (3, "dup", "c")], "doc_id long, text string, start string")
    got = read_token_files(write_token_files(df, WORD)).toPandas().sort_values("start")
    assert len(got) == len(TEXTS) + 3 and got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1]]
    ids = got["doc_id"].tolist()
    assert ids[0] != ids[0] and ids[1:] == sorted(ids[1:])
    for i, t in enumerate(TEXTS):
        want = ENCODERS[0][0].encode(t) + struct.pack("<I", 1)
        row = got[got["doc_id"] == 10 - i]
        assert (len(want) // 4, zlib.crc32(want)) in list(zip(row["n_tokens"], row["ids_crc32"], strict=True))
    assert read_token_files(write_token_files(df.where("false"), WORD)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_is_a_partition(sizes, k):
    wins = differencing(np.array(sizes), k)
    assert sorted(i for w in wins for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in windows_of(np.array(sizes), 120)) <= 120


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 500, 2000)
    sums = [sizes[w].sum() for w in differencing(sizes, 100)]
    assert max(sums) - min(sums) <= 30 and len(windows_of(sizes, 2048)) <= 1.03 * sizes.sum() / 2048 + 1


def test_packing(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, "word " * 9000, "dup", "dup"])] + [(None, "n", 1)], "doc_id long, text string, length int")
    got = pack_documents(df, BYTE).toPandas()
    for i, t in enumerate([*TEXTS, "word " * 9000, "dup", "dup"]):
        want = ENCODERS[1][0].encode(t) + struct.pack("<I", 1)
        mine = got[got["doc_id"] == i].sort_values("start")
        assert mine["start"].tolist() == [0, *np.cumsum(mine["length"])[:-1]] and mine["length"].sum() == len(want) // 4 and mine["doc_tokens"].eq(len(want) // 4).all()
        assert mine["ids_crc32"].tolist() == [zlib.crc32(want[4 * a : 4 * (a + n)]) for a, n in zip(mine["start"], mine["length"], strict=True)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048
    assert pack_documents(df.where("false"), BYTE).count() == 0


def test_cut_document_covers_every_id():
    ids = np.arange(5000, dtype="<u4").tobytes()
    cuts = cut_document(ids)
    assert [a for a, _, _ in cuts] == [0, *np.cumsum([n for _, n, _ in cuts])[:-1]] and sum(n for _, n, _ in cuts) == 5000


def test_a_worker_keeps_the_words_of_one_operator():
    from gridloom.llm import caches, jaccard, quality

    first = quality.features(b"some words here, some words")
    assert len(quality._WORDS) == 3
    jaccard.shingle_set(b"a b c d", 3)
    assert len(quality._WORDS) == 0 and len(quality._WORDS.slots) == 0 and len(jaccard._HASHES) == 4
    jaccard.shingle_set(b"a b c e", 3)
    assert len(jaccard._HASHES) == 5
    again = quality.features(b"some words here, some words")
    assert all((a == b).all() for a, b in zip(first, again, strict=True)) and len(jaccard._HASHES) == 0
    assert caches._HELD == [quality._WORDS]


def test_a_change_of_caches_gives_memory_back(monkeypatch):
    from gridloom.llm import caches

    calls = []
    monkeypatch.setattr(caches, "_HELD", [])
    monkeypatch.setattr(caches, "_release", lambda: calls.append(1))
    first, second = {1: 1}, {2: 2}
    for cache in (first, first, second, second, first):
        caches.hold(cache)
    assert len(calls) == 3 and first == {} and second == {}
