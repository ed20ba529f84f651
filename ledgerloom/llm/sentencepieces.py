"""Operator 10 - offset-preserving SentencePiece encoding and decoding.

The model file's own normaliser is applied here: longest-prefix matches of the
compiled character map (a double-array trie over UTF-8 with its replacement
strings), the dummy prefix, optional removal of extra blanks, and the blank
symbol.  Each normalised byte keeps the source byte it came from, so every
piece is projected to a span of original bytes.  Piece segmentation is BPE
over the normalised text; as no piece holds the blank symbol after another
character, each blank-led unit is segmented once per worker by the library.

Null and empty texts give only the begin and end ids; long texts are handled
unit by unit; repeated rows give repeated results; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table
from .tokens import slices

#: The library's symbol for a blank.
BLANK = "▁"
CACHE_UNITS = 500_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def proto_fields(data: bytes):
    """(field number, value) pairs of a protobuf message, in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: trie size, double-array units, replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        if not self.units:
            return None
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1] : end]


class Normaliser:
    def __init__(self, charmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy, self.squeeze = CharMap(charmap), dummy_prefix, squeeze
        self.blank = BLANK.encode() if escape else b" "
        self.plain = not charmap and not squeeze

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte."""
        data, out, source = text.encode(), bytearray(), []
        chunks, at = [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                hit = size, data[at : at + size]
            chunks.append((at, hit[1]))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            while chunks and chunks[0][1].strip(b" ") == b"":
                chunks.pop(0)
            while chunks and chunks[-1][1].strip(b" ") == b"":
                end = chunks.pop()[0]
        if not chunks:
            return b"", np.array([end], np.int64)
        if self.dummy:
            chunks.insert(0, (chunks[0][0], b" "))
        space = False
        for at, piece in chunks:
            for byte in (piece[i : i + 1] for i in range(len(piece))):
                if byte == b" ":
                    if self.squeeze and space and out:
                        continue
                    out += self.blank
                    source += [at] * len(self.blank)
                else:
                    out += byte
                    source.append(at)
                space = byte == b" "
        return bytes(out), np.array([*source, end], np.int64)


class PieceEncoder:
    _of: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = f.read()
        rule: dict = {}
        names: list[tuple[str, int]] = []
        for field, value in proto_fields(model):
            if field == 1:
                piece = dict(proto_fields(value))
                names.append((piece[1].decode(), piece.get(3, 1)))
            elif field == 3:
                rule = dict(proto_fields(value))
        self.normalise = Normaliser(rule.get(2, b""), bool(rule.get(3, 1)), bool(rule.get(4, 1)), bool(rule.get(5, 1)))
        #: source bytes of each id's piece under an identity map: a blank symbol stands for one byte
        self.width = np.array([1 if kind == 6 else len(name.replace(BLANK, " ").encode()) for name, kind in names], np.int64)
        self.unknown = {i for i, (_, kind) in enumerate(names) if kind == 2}
        apart = not any(BLANK in name.lstrip(BLANK) for name, _ in names)
        lines = not any("\n" in name for name, _ in names)
        self.by_unit = apart and lines and self.normalise.plain and self.normalise.dummy
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.units: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids with begin and end, as arrays of uint32."""
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        out: list = [b""] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        whole, units, missing = [], self.units, set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_unit or "  " in text or BLANK in text or text[0] == " " or "\0" in text:
                whole.append(i)
                continue
            own = text.replace("\n", " \n").split(" ")
            if own[0] == "":  # the text begins with a line end, after the dummy prefix
                whole.append(i)
                continue
            parts.append((i, own))
            missing.update(u for u in own if u not in units)
        if missing:
            keys = list(missing)
            lead = self.library.piece_to_id(BLANK)
            for key, ids in zip(keys, self.library.encode(keys, num_threads=1)):
                if key == "":
                    ids = [lead]
                elif key[0] == "\n":  # the library's dummy prefix cannot merge with a line end
                    ids = ids[1:]
                units[key] = np.array(ids, "<u4").tobytes()
        for i, own in parts:
            out[i] = b"".join(map(units.__getitem__, own))
        for i, ids in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1)):
            out[i] = np.array(ids, "<u4").tobytes()
        edge = [np.array([x], "<u4").tobytes() for x in (self.bos, self.eos)]
        return [np.frombuffer(edge[0] + x + edge[1], "<u4") for x in out]

    def spans(self, text: str | None, ids: np.ndarray) -> np.ndarray:
        """(n, 2) original byte spans of every id; begin and end ids are empty."""
        size = len((text or "").encode())
        inner = ids[1:-1]
        if self.normalise.plain and not (set(inner.tolist()) & self.unknown) and BLANK not in (text or ""):
            ends = np.cumsum(self.width[inner]) - (1 if len(inner) and self.normalise.dummy else 0)
            ends = np.minimum(ends, size)
            starts = np.concatenate([[0], ends[:-1]]) if len(inner) else ends
        else:
            norm, source = self.normalise(text or "")
            at, starts, ends = 0, [], []
            for piece in self.library.encode(text or "", return_type="proto").pieces:
                # an unknown piece names its normalised text, a byte piece stands for one byte
                width = 1 if re.fullmatch("<0x[0-9A-F]{2}>", piece.piece) else len(piece.piece.encode())
                starts.append(source[at])
                at = min(at + width, len(norm))
                ends.append(source[at])
        edge = np.array([[0, 0]], np.int64), np.array([[size, size]], np.int64)
        return np.concatenate([edge[0], np.stack([np.asarray(starts, np.int64), np.asarray(ends, np.int64)], 1), edge[1]])


def encode_pieces(docs: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """Per document: ids, byte spans and decoded text; with ``digest`` only
    their counts and hashes (the shape of the query)."""

    bound_batches(docs.sparkSession)
    def run(batches):
        encoder = PieceEncoder.of(model)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids = encoder.encode(texts[lo:hi])
                back = encoder.library.decode([x.tolist() for x in ids], num_threads=1)
                spans = [encoder.spans(t, x) for t, x in zip(texts[lo:hi], ids)]
                if digest:
                    columns = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                        pa.array([hashlib.sha256(x.astype("<i8").tobytes()).hexdigest() for x in spans]),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
                else:
                    columns = [
                        pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())),
                        pa.array([x[:, 0] for x in spans], pa.list_(pa.int64())),
                        pa.array([x[:, 1] for x in spans], pa.list_(pa.int64())),
                        pa.array(back, pa.string()),
                    ]
                    names = ["ids", "starts", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), *columns], names=["doc_id", *names])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digest else "ids array<long>, starts array<long>, ends array<long>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, {out}")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
