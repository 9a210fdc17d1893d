"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is done here: at each place of the text the longest prefix that the model's compiled character map (a
double-array trie and a pool of replacements) knows is replaced, and each normalised byte records the original byte
it came from. The normalised bytes are what is encoded: the library's merges run on them under a copy of the model whose own
normaliser is switched off. The lengths of the pieces and the alignment give each piece the original bytes it covers.

Defined results: a null text counts as empty; an empty text has begin and end ids alone and decodes to an empty
text; a text whose pieces don't add up to the normalised bytes (which no model here does) has ids but empty spans; ids may
be null or repeated, rows are independent; texts are taken whole, however long; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import documents, id_and_text, steps

META = "▁".encode()


class CharMap:
    """A precompiled character map: 4 bytes of trie size, the trie's 32-bit units, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of text[at:]."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        node ^= _offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= _offset(units[node])
            if leaf:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class Normalizer:
    """normalize() gives the normalised bytes and, for each of them and the end, the original byte offset."""

    def __init__(self, spec, treat_space_as_suffix: bool = False, user_symbols: tuple[bytes, ...] = ()):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = treat_space_as_suffix
        self.symbols = sorted(user_symbols, key=len, reverse=True)
        self.plain = not self.map.units and not self.squeeze and not self.symbols and not self.suffix and self.escape

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if text.startswith(s, at):
                return len(s), s
        if known := self.map.longest(text, at):
            return known
        first = text[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, text[at : at + n]

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        return self._fast(text) if self.plain else self._slow(text)

    def _fast(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No map: only spaces change, each to a longer symbol."""
        out = text.replace(b" ", META)
        lead = META if self.prefix else b""
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 32, len(META), 1)
        at = np.repeat(np.arange(len(raw)), width)
        return lead + out, np.concatenate([np.zeros(len(lead), np.int64), at, [len(raw)]])

    def _slow(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = META if self.escape else b" "
        out, align, at = bytearray(), [], 0
        while self.squeeze and at < len(text):
            n, new = self._step(text, at)
            if new.strip(b" "):
                break
            at += n
        if at == len(text):
            return b"", np.zeros(1, np.int64)

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            align.extend([origin] * len(piece))

        if self.prefix and not self.suffix:
            put(space, at)
        after_space = self.squeeze
        while at < len(text):
            n, new = self._step(text, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", space), at)
                after_space = self.squeeze and new.endswith(b" ")
            at += n
        end = len(text)
        while self.squeeze and out.endswith(space):
            end = align[-len(space)]
            del out[-len(space) :], align[-len(space) :]
        if self.prefix and self.suffix:
            put(space, end)
        return bytes(out), np.array([*align, end], np.int64)


class Encoder:
    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        plain = sentencepiece_model_pb2.ModelProto()
        plain.CopyFrom(proto)
        spec = plain.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == 4)
        self.normalizer = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix, symbols)
        #: Normalised bytes under each id: a byte piece stands for one, control pieces for none, the unknown piece for what is left.
        self.width = np.array([1 if p.type == 6 else 0 if p.type == 3 else -1 if p.type == 2 else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """The ids, and for each a row of (first byte, byte after the last) of the original text; control ids cover nothing."""
        normal, align = self.normalizer.normalize(text.encode())
        ids = self.merges.encode(normal, add_bos=True, add_eos=True, num_threads=1)
        width = self.width[np.asarray(ids, np.int64)]
        if (width < 0).any():
            pieces = self.merges.encode(normal, out_type=str, add_bos=True, add_eos=True, num_threads=1)
            width = np.array([len(p.encode()) if w < 0 else w for p, w in zip(pieces, width, strict=True)], np.int64)
        ends = np.cumsum(width)
        if ends[-1] != len(normal):
            return ids, np.zeros((len(ids), 2), np.int64)
        return ids, np.stack([align[ends - width], align[ends]], axis=1)

    def ids(self, text: str) -> list[int]:
        return self.encode(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.lru_cache(4)
def encoder(model: str) -> Encoder:
    return Encoder(model)


FULL = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _full(doc_id, text: str, e: Encoder) -> tuple:
    ids, spans = e.encode(text)
    return doc_id, ids, spans[:, 0].tolist(), spans[:, 1].tolist(), e.decode(ids)


def _digest(doc_id, text: str, e: Encoder) -> tuple:
    ids, spans = e.encode(text)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return doc_id, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(e.decode(ids).encode()), sha(spans.astype("<u4").tobytes())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids with begin and end, each id's original byte span, and the decoded text; with `digests`, their hashes."""
    schema, row = (DIGEST, _digest) if digests else (FULL, _full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for ids, texts in steps(batches):
            rows = [row(i, t, e) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), ARROW[schema], strict=True)], NAMES[schema])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


NAMES = {x: [c.split()[0] for c in x.split(", ")] for x in (FULL, DIGEST)}
_KIND = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
ARROW = {x: [_KIND[c.split()[1]] for c in x.split(", ")] for x in (FULL, DIGEST)}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
