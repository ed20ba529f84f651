import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.packing import nnls, pack, plan
from ledgerloom.llm import packing, seekable
from ledgerloom.llm.seekable import SeekableReader, SeekableWriter, read_token_files, write_token_files
from ledgerloom.llm.sentencepieces import CharMap, Normaliser, PieceEncoder, encode_pieces
from ledgerloom.llm.tokens import BpeEncoder

from .conftest import edge_rows

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  a  b ", "a\nb\tc", "ﬁ é 　x​", "<s>a</s>", "▁x ▁ y", "", " ", "\n", "\n\na", "a\n", "a \n b", "it's 12's", "a\0b", "c \0d", "\0", "日本 語", "x\x1fy z", "a\x85b", "<|endoftext|> a"]


def test_bpe_equals_the_library():
    encoder = BpeEncoder.of(BPE)
    texts = HARD + [t or "" for _, t in edge_rows()]
    assert encoder.encode(texts) == encoder.whole(texts) == encoder.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab.,'é▁日\0 ", max_size=30), min_size=1, max_size=5))
def test_encoders_equal_their_libraries_on_any_text(texts):
    bpe, pieces = BpeEncoder.of(BPE), PieceEncoder.of(PIECES)
    assert bpe.encode(texts) == bpe.whole(texts)
    ids = pieces.encode(texts)
    assert [x.tolist() for x in ids] == pieces.library.encode(texts, add_bos=True, add_eos=True)
    for text, own in zip(texts, ids):
        data = text.encode()
        assert b"".join(data[a:b] for a, b in pieces.spans(text, own)) == data


def test_character_map_takes_the_longest_prefix():
    # a trie with the keys "a" and "ab", built by hand in double-array form
    units = [0] * 1024
    base = 256 | ord("a")

    def unit(offset, label, leaf):
        return (offset << 10) | (256 if leaf else 0) | label

    units[0] = 256 << 10
    at_a = 256 ^ ord("a")
    units[at_a] = unit(512 ^ 0, ord("a"), True)
    node = at_a ^ 512
    units[node] = (1 << 31) | 0
    at_b = node ^ ord("b")
    units[at_b] = unit(128, ord("b"), True)
    units[at_b ^ 128] = (1 << 31) | 2
    blob = np.array([4 * len(units)], "<u4").tobytes() + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    found = CharMap(blob)
    assert found.longest(b"ac", 0) == (1, b"x") and found.longest(b"abc", 0) == (2, b"yz") and found.longest(b"c", 0) is None
    norm, source = Normaliser(blob, True, True, True)(" ab a ")
    assert norm.decode() == "▁yz▁x" and source.tolist() == [1, 1, 1, 1, 1, 3, 3, 3, 4, 5]
    assert base


def test_sentencepiece_query_shape(spark, edge, nothing):
    rows = {(r.doc_id, r.n_tokens) for r in encode_pieces(edge, PIECES, digest=True).collect()}
    assert (1, 2) in rows and (2, 2) in rows and len(rows) == 14
    full = {r.doc_id: r for r in encode_pieces(edge, PIECES).collect()}
    assert full[5].decoded == "a b" and full[5].ends[-1] == 3
    assert encode_pieces(nothing, PIECES).count() == 0


def test_seekable_file_reads_only_what_is_asked():
    import io

    stream = io.BytesIO()
    writer = SeekableWriter(stream, frame_ids=100)
    docs = [(k, np.arange(k * 7 + 1, dtype="<u4").tobytes()) for k in range(30)]
    for key, ids in docs:
        writer.add(key, ids)
    size = writer.finish()
    assert size == len(stream.getvalue())
    assert [(k, ids) for k, _, ids in SeekableReader(stream, size).documents()] == docs
    reader, opened = SeekableReader(stream, size), []
    frame = reader.frame
    reader.frame = lambda n: opened.append(n) or frame(n)
    assert [k for k, _, _ in reader.documents([3, 29])] == [3, 29] and len(opened) == 2
    raw = bytearray(stream.getvalue())
    raw[5] ^= 255
    with pytest.raises(Exception):
        list(SeekableReader(io.BytesIO(bytes(raw)), size).documents([0]))


def test_token_files_round_trip(spark, edge, nothing, tmp_path):
    encoder = BpeEncoder.of(BPE)
    manifest = write_token_files(edge, BPE, f"file://{tmp_path}/files")
    found = sorted(tuple(r) for r in read_token_files(manifest).collect())
    start, expected = 0, []
    for key, text in sorted((r for r in edge_rows() if r[0] is not None), key=lambda r: r[0]):
        ids = encoder.encode([text])[0] + b"\0\0\0\0"
        expected.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert found == expected
    assert read_token_files(write_token_files(nothing, BPE, f"file://{tmp_path}/none")).count() == 0


def check_plan(histogram, capacity):
    segments = plan(histogram, capacity)
    placed, spans = {}, {}
    for length, rank, count, first, offset in sorted(segments):
        assert rank == placed.get(length, 0)
        placed[length] = rank + count
        for k in range(count):
            spans.setdefault(first + k, []).append((offset, length))
    assert placed == {n: c for n, c in histogram.items() if c}
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(spans)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plan_places_every_piece_once(histogram):
    used = check_plan(histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    assert used >= -(-total // 64) and used <= 2 * total / 64 + 1


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, np.exp(rng.normal(6, 1, 20_000))).astype(int) + 1
    histogram = dict(zip(*(x.tolist() for x in np.unique(np.minimum(lengths, 2048), return_counts=True))))
    used = check_plan(histogram, 2048)
    assert used <= 1.01 * sum(n * c for n, c in histogram.items()) / 2048 + 1


@pytest.mark.parametrize("low,high,pieces", [(3, 3, 100_000), (20, 60, 20_000), (50, 200, 20_000), (100, 400, 20_000), (1, 2048, 20_000)])
def test_patterns_never_cost_sequences(low, high, pieces):
    lengths = np.random.default_rng(2).integers(low, high + 1, pieces)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    fitted, plain = packing._plan(histogram, 2048, 2048), packing._plan(histogram, 2048, -1)
    assert check_plan(histogram, 2048) <= packing._sequences(plain)
    assert fitted != plain or low == high  # the fit does place pieces


def test_least_squares_stays_non_negative():
    a, b = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 3.0])
    x = nnls(a, b)
    assert (x >= 0).all() and np.allclose(x, [0, 2], atol=1e-3)


def test_packing_covers_all_documents(spark, edge, nothing):
    encoder, rows = BpeEncoder.of(BPE), pack(edge, BPE, capacity=64).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for key, text in edge_rows():
        ids = encoder.encode([text])[0] + b"\0\0\0\0"
        total = len(ids) // 4
        cuts = [0, *range((total - 1) % 64 + 1, total, 64), total]
        expected += [(key or -1, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 64
    assert pack(nothing, BPE).count() == 0


def test_token_files_leave_out_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "no id"), (3, "three"), (None, None)], "doc_id long, text string")
    manifest = write_token_files(docs, BPE, f"file://{tmp_path}/nulls")
    assert [r.doc_id for r in read_token_files(manifest).collect()] == [3]
    assert "null doc_id" in seekable.__doc__
