"""Byte-level BPE ids of whole texts.

BPE merges never cross the borders of the pre-tokeniser, so a text is the
concatenation of its space-led chunks, and each different chunk goes through
the ``tokenizers`` library once per worker.  Texts in which a chunk border
would not be a pre-token border (runs of blanks or line ends, characters whose
class has changed between Unicode versions) go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Chunks remembered by a worker; when full, it starts afresh.
CACHE_CHUNKS = 900_000
#: Characters of the same class in every Unicode version; a chunk with another
#: one sends its text through the library whole, and so do gaps of two.
_ODD = re.compile("[^\n\x21-\x7e\xa1-\u024f]")
#: Characters of texts encoded together.
SLICE = 8_000_000
#: Chunks of one call to the library.
_TOGETHER = 256


class BpeEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    _of: dict[str, BpeEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.chunks: dict[str, bytes | int] = {}
        self.most_chunks = CACHE_CHUNKS
        size = self.tokenizer.get_vocab_size()
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        #: whether an id's bytes begin with a blank
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(size)])

    @classmethod
    def of(cls, path: str, most_chunks: int = CACHE_CHUNKS) -> BpeEncoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        cls._of[path].most_chunks = most_chunks
        return cls._of[path]

    def forget(self) -> None:
        """Give the memory of the remembered chunks back."""
        self.chunks.clear()
        give_back()

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, missing: set[str]) -> None:
        """Ids of new chunks; 0 for a chunk with an odd character."""
        alone, joined = [], []
        for key in missing:
            (joined if key and key[0] > " " else alone).append(key)
        self.chunks.update((key, 0) for key in alone if _ODD.search(key, 1 if key[:1] == "\0" else 0))
        alone = [key for key in alone if key not in self.chunks]
        self.chunks.update(zip(alone, self.whole([key[1:] if key[:1] == "\0" else key or " " for key in alone])))
        # a blank opens each of these chunks and stands nowhere else, so it also tells their ids apart
        runs = [joined[i : i + _TOGETHER] for i in range(0, len(joined), _TOGETHER)]
        texts = []
        for k, keys in enumerate(runs):
            if _ODD.search("".join(keys)):
                self.chunks.update((x, 0) for x in keys if _ODD.search(x))
                runs[k] = keys = [x for x in keys if not _ODD.search(x)]
            texts.append(" " + " ".join(keys) if keys else "")
        for keys, found in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            starts = (4 * np.flatnonzero(self.leads[ids])).tolist()
            raw = ids.tobytes()
            self.chunks.update(zip(keys, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)]))))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty.

        Splitting, finding the different chunks of the batch and laying out
        their ids run in Arrow; Python sees each different chunk once a batch.
        """
        chunks = self.chunks
        if len(chunks) > self.most_chunks:
            chunks.clear()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        whole = pc.match_substring_regex(texts, r"[ \n]{2}|\x00").to_numpy(zero_copy_only=False)
        # a line end starts a chunk of its own, every other chunk but the first has its blank
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        parts = pc.split_pattern(marked, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(chunks.get, names))
        missing = {name for name, ids in zip(names, found) if ids is None}
        if missing:
            self._learn(missing)
            found = [chunks[n] if ids is None else ids for n, ids in zip(names, found)]
        odd = np.array([ids == 0 for ids in found])
        if odd.any():  # a chunk that must not be cut out
            found = [ids or b"" for ids in found]
            whole = whole | (np.add.reduceat(odd[at], bounds[:-1]) > 0)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<u4")))
        raw = ids.take(coded.indices).flatten().to_numpy().tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes[at])])[bounds]
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        out = [x if n else b"" for x, n in zip(out, pc.binary_length(texts).to_pylist())]
        rest = np.flatnonzero(whole).tolist()
        for i, x in zip(rest, self.whole(texts.take(pa.array(rest, pa.int64())).to_pylist())):
            out[i] = x
        return out


def slices(texts: list | pa.Array, most_chars: int = 2_000_000):
    """Runs of a batch with a bounded sum of characters (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_chars:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)
