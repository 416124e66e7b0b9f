import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import byte_bpe, packing, token_count

ALPHABET = ["a", "b", "'s", " ", "  ", "ll", "1", "١", "Ⅰ", "\n", "\t", ",", ".", "é", "Ａ", "中", "😀", "<s>", "<|endoftext|>", "\x00", "​", "▁", "\x1c", "\x85", "\xa0", "　", "ing", "tion"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def piece_counts():
    import sentencepiece

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    model = token_count.PieceModel.from_bytes(data)
    return token_count.Counts(model, model.proven()), sentencepiece.SentencePieceProcessor(model_proto=data)


@pytest.fixture(scope="module")
def coder():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.Encoder(ranks, byte_bpe.PerfectHash.of(ranks)), ranks


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_piece_counts_equal_the_library(piece_counts, text):
    counts, library = piece_counts
    assert token_count.count_tokens(text, counts) == len(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ranks_equal_the_library(coder, text):
    import tiktoken

    encode, ranks = coder
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = encode.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert encode.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_packing_ids_equal_the_library(text):
    import tokenizers

    global _PAIR
    if "_PAIR" not in globals():
        with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            _PAIR = packing.encoder(f.read()), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert _PAIR[0](text) == _PAIR[1].encode(text, add_special_tokens=False).ids


def test_perfect_hash_is_minimal(coder):
    table = coder[0].table
    assert len(table.keys) == len(coder[1]) and all(table.get(k) == v for k, v in list(coder[1].items())[::97])
    assert table.get(b"not a token at all") is None and byte_bpe.PerfectHash.of({b"a": 5}).get(b"a") == 5


def test_long_runs(coder, piece_counts):
    text = "ab" * 100_000
    assert coder[0].decode(coder[0].encode(text)) == text.encode()
    assert token_count.count_tokens("x" * 100_000, piece_counts[0]) > 0


def test_operators_on_awkward_rows(spark, awkward, piece_counts):
    rows = token_count.token_counts(awkward, P.path("piece_bpe_32k.model"), 4096).collect()
    texts = sorted((r.text or "") for r in awkward.collect())
    assert sorted(r.n_bytes for r in rows) == sorted(len(t.encode()) for t in texts)
    assert sorted(r.n_tokens for r in rows) == sorted(len(piece_counts[1].encode(t)) for t in texts)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)
    back = byte_bpe.bpe_round_trip(awkward, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    assert sorted(r.decoded_sha256 for r in back) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert all(r.decoded.encode() == b"" or hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in back)
    for op in (token_count.token_counts(awkward.limit(0), P.path("piece_bpe_32k.model"), 1), byte_bpe.bpe_round_trip(awkward.limit(0), P.path("byte_bpe_multi_50k.tiktoken"))):
        assert op.count() == 0


def test_packing_bounds_and_fits():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([10, 33, 64])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 60))])
        bins, offsets, room = packing.best_fit_decreasing(lengths, capacity)
        for b in range(len(room)):
            inside = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
            assert sum(n for _, n in inside) == capacity - room[b] and all(o == sum(n for _, n in inside[:i]) for i, (o, _) in enumerate(inside))
        bound = packing.lower_bound(lengths, capacity)
        assert -(-int(lengths.sum()) // capacity) <= bound <= len(room)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([], np.int64), 10) == 0


def test_pack_covers_every_document(spark, awkward):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(awkward, P.path("byte_bpe_50k.json"), capacity=512).collect()
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r.length for r in rows) == sum(want) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(1 for r in rows) == sum(-(-n // 512) for n in want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(n for _, n in inside) <= 512
    assert packing.pack(awkward.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_exchanges_gain_bins():
    rng, gained = random.Random(9), 0
    for seed in range(40):
        capacity = 100
        lengths = np.array([n for _ in range(25) for n in (lambda a, b: (a, b, 100 - a - b))(rng.randint(20, 45), rng.randint(20, 45))])
        bins, offsets, room = packing.best_fit_decreasing(lengths, capacity)
        bound = packing.lower_bound(lengths, capacity)
        after, places, left = packing.tightened(lengths, bins, offsets, room, capacity, bound, seed)
        gained += len(room) - len(left)
        assert bound <= len(left) <= len(room)
        for b in range(len(left)):
            inside = sorted(zip(places[after == b].tolist(), lengths[after == b].tolist(), strict=True))
            assert sum(n for _, n in inside) == capacity - left[b] and all(o == sum(n for _, n in inside[:i]) for i, (o, _) in enumerate(inside))
    assert gained >= 20


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000, "a" + " \t" * 400_000 + "b"], ids=["blanks", "lines", "mixed"])
def test_long_white_space(text, coder, piece_counts):
    import tokenizers

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        ids = packing.encoder(f.read())(text)
    assert ids == tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert coder[0].decode(coder[0].encode(text)) == text.encode()
    assert token_count.count_tokens(text, piece_counts[0]) == len(piece_counts[1].encode(text))


def test_pack_query_equals_the_library(spark, sf_dir):
    import zlib

    import tokenizers

    from quarry.llm import queries

    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in queries.op9_best_fit_packing(spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        n = max(1, -(-len(ids) // 2048))
        ends = [len(ids) - 2048 * (n - 1 - i) for i in range(n)]
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            want[(r.doc_id, i)] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert rows == want


def test_whole_tables_equal_the_libraries(spark, sf_dir):
    import sentencepiece
    import tiktoken

    from quarry.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf_dir).collect()}
    assert counted == {i: (len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in texts.items()}
    ranks = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, sf_dir).collect()}
    ids = {i: np.array(ranks.encode_ordinary(t), "<u4") for i, t in texts.items()}
    assert coded == {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}


def test_groups_exchange_until_the_bound(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json")).collect()
    bound = packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert len({r.sequence_id for r in rows}) <= bound + 2
