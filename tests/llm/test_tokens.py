import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, pfor, token_output
from tessera.llm.tokens import UnitEncoder, vocabulary_file

TOKENIZER = Tokenizer.from_file(vocabulary_file())


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_units_equal_whole_texts():
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "foo", "foo,", "bar.", "'s", "12", "é", "日本", "!", "<|endoftext|>", "\x1c", "\x85", "👍🏽", "Ġ", "　", "​", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    encoder = UnitEncoder(vocabulary_file(), capacity=500)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 50257, 2**32 - 1])
@pytest.mark.parametrize("percentile", [0, 50, 95, 100])
def test_blocks_round_trip(n, top, percentile):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.05, rng.integers(0, top, n, endpoint=True), rng.integers(0, min(top, 90) + 1, n)).astype(np.uint32)
    lengths = [n // 3, n - 2 * (n // 3), n // 3]
    segment = pfor.Segment(pfor.encode_segment([5, None, 7], lengths, values, percentile=percentile))
    assert (segment.decode() == values).all() and segment.doc_ids == [5, None, 7]
    for k in range(3):
        at = sum(lengths[:k])
        assert (segment.document(k) == values[at : at + lengths[k]]).all()
    with pytest.raises(ValueError):
        pfor.Segment(b"x" * 24)


def test_token_files(spark, edges, nothing, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_tokens(edges, path, segment_ids=4000)
    rows = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    source = [(r.doc_id, [*ids(r.text), 0]) for r in edges.collect()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d), len(v), crc(v)) for d, v in source)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in rows]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert {r.doc_id: r.ids for r in token_output.read_ids(spark, path, [7, 8]).collect()} == {7: source[7][1], 8: source[8][1]}
    empty = str(tmp_path / "none")
    token_output.write_tokens(nothing, empty)
    assert token_output.read_tokens(spark, empty).count() == 0


def check_packing(rows, source, capacity, max_docs=10**9, max_attention=10**18):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, values in source.items():
        at = 0
        for k, p in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, crc(values[at : at + p.length])) and (k == 0 or p.length == capacity)
            at += p.length
        assert at == len(values) and (len(values) > capacity or len(pieces[doc]) == 1)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(b) <= max_docs and (len(b) == 1 or sum(r.length**2 for r in b) <= max_attention)
    return len(bins)


def test_packing(docs):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.choice((3, 40, 300, 900, 2500)))) for _ in range(300)] + [None, ""]
    source = {i: [*ids(t), 2] for i, t in enumerate(texts)}
    n = check_packing(packing.best_fit_pack(docs(texts)).collect(), source, 1024)
    room = []  # first fit, in falling size
    for size in sorted((len(v) % 1024 for v in source.values()), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= size), None)
        if k is None:
            room.append(1024 - size)
        else:
            room[k] -= size
    assert n <= len(room) + sum(len(v) // 1024 for v in source.values()) + 1
    dot = packing.best_fit_pack(docs(texts), rule="dot").collect()
    check_packing(dot, source, 1024)
    tight = packing.best_fit_pack(docs(texts), max_docs=4, max_attention=400_000).collect()
    check_packing([r for r in tight if r.length**2 <= 400_000], {}, 1024, 4, 400_000)


def test_packing_edges(edges, nothing):
    rows = packing.best_fit_pack(edges).collect()
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) + 1 for r in edges.collect())
    assert packing.best_fit_pack(nothing).count() == 0
