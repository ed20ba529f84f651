import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__
from ledgerloom.llm.alignment import Aligner, Batch, align, byte_level

from .conftest import edge_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  a  b ", "a\nb\tc", "ﬁ é 　x​", "<s>a</s>", "▁x ▁ y", "", " ", "\n", "\n\na", "a\n", "a \n b", "it's 12's", "a\0b", "日本 語", "a b日c é", "<|endoftext|> a", "Élan, naïve\nçouelle", "tail ", "x\x85y", "🙂 ok 🙂"]


def plain(texts):
    """The contract read literally: every token of the whole text, every pair of
    occurrences compared."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = byte_level()
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a_ids = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_lib.encode(text) if text else []
        a_raw = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a_ids]
        b_raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b_ids)]
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            found.append(([], [], [], []))
            continue
        spans = []
        for own in (a_raw, b_raw):
            at, here = 0, []
            for x in own:
                here.append((at, at + len(x)))
                at += len(x)
            spans.append(here)
        a_ends, b_ends = {e for _, e in spans[0]}, {e for _, e in spans[1]}
        both = sorted(a_ends & b_ends)
        groups = [[[], []] for _ in both]
        for side, (ids, own) in enumerate(zip((a_ids, b_ids), spans)):
            for i, (_, e) in zip(ids, own):
                groups[bisect_left(both, e)][side].append(str(i))
        groups = ["|".join(",".join(x) for x in g) for g in groups]
        links, b_starts = [], [s for s, _ in spans[1]]
        for i, (s, e) in zip(a_ids, spans[0]):
            j = bisect_right(b_starts, s) - 1
            while j < len(b_ids) and spans[1][j][0] < e:
                links.append((i, b_ids[j]))
                j += 1
        found.append((a_ids, b_ids, groups, links))
    counts = Counter(x for *_, links in found for x in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (len(a), len(b), len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, links in found
    ]


def values(rows):
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r[0])]


@pytest.fixture(scope="module")
def documents(corpus):
    texts = [t for _, t in corpus] + HARD + [None] + [t for t in HARD if t]
    return [(i, t) for i, t in enumerate(texts)]


def test_query_equals_brute_force(spark, documents, tmp_path):
    spark.createDataFrame(documents, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op11_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert values(got.collect()) == plain([t for _, t in documents])


@pytest.mark.parametrize("most_hot", [1, 40, 500])
def test_rare_pairs_give_the_same_sums(spark, documents, most_hot):
    df = spark.createDataFrame(documents[150:], "doc_id long, text string").repartition(3)
    assert values(align(df, A, B, most_hot=most_hot).collect()) == plain([t for _, t in documents[150:]])


def test_what_a_worker_remembers_changes_nothing(documents):
    few = documents[::9]
    aligner = Aligner(A, B)
    for _, text in few:
        aligner.forget()
        found = Batch(aligner, pa.array([text], pa.string()))
        n = [int(found.total(aligner.counts[:, k])[0]) for k in range(4)]
        if len(found.alone):
            n = aligner.whole(text)[0].tolist()
        assert n == list(plain([text])[0][:4])


def test_edges(spark, edge, nothing):
    got = sorted(align(edge, A, B).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    expected = plain([t for _, t in sorted(edge_rows(), key=lambda r: (r[0] is None, r[0] or 0))])
    assert [tuple(r)[1:] for r in got] == expected
    assert got[0][1:] == (0, 0, 0, 0, 0, 0, "") and got[-1][0] is None
    assert align(nothing, A, B).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in align(empty, A, B).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_labels_and_groups():
    aligner = Aligner.of(A, B)
    a, b = np.array(aligner.a.tokenizer.encode(" hello").ids), np.array(aligner.b.library.encode("hello"))
    aligner.forget()
    labels = aligner.labels(a, b, 6)
    assert labels[-1] == 3 and (labels > 0).sum() >= 1
    groups, ends, pairs = aligner.scan(a, b, labels)
    assert ends[-1] == 6 and "".join(groups).count("|") == len(groups) and len(pairs) == (labels > 0).sum()
