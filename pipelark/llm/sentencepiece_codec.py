"""SentencePiece encoding and decoding with a prefix table.

Works with models of the merge (BPE) type whose normaliser is the identity.  A
text gets the model's leading space mark, spaces become marks, and each run
between two word starts is split by :class:`~pipelark.llm.merges.MergeVocabulary`:
the table stores the one last token of every prefix, and the ids are recovered
backwards.  No piece holds a mark behind another character, so that no join
crosses a word start and runs can be split apart and remembered; a model that
has such pieces is split text by text.
"""

from __future__ import annotations

import array
import codecs
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import extended, mapped
from .merges import Memo, MergeVocabulary
from .session import ready

MARK = "▁"


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("pipelark-byte-by-byte", _byte_by_byte)


class PieceCodec:
    """Encoder and decoder of one model file, given as bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        normal = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only models of the merge type have a prefix table")
        if normal.name != "identity" or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models that leave texts as they are can be encoded")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces are matched before any join and aren't supported")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) < 256:
            raise ValueError("a model must spell characters outside its vocabulary with bytes")
        pieces = {i: p.piece for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        scores = {i: -p.score for i, p in enumerate(spec.pieces)}
        ids = {piece: i for i, piece in pieces.items()}

        def join(a: int, b: int) -> tuple[float, int] | None:
            made = ids.get(pieces[a] + pieces[b])
            return None if made is None else (scores[made], made)

        self.vocabulary = MergeVocabulary(pieces, join)
        apart = not any(MARK in p.lstrip(MARK) for p in pieces.values())
        lines = not any("\n" in p for p in pieces.values())
        self.runs = re.compile(rf"\n+|{MARK}*[^{MARK}\n]+|{MARK}+" if apart and lines else rf"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s:.+)").findall
        self.memo = Memo(lambda run: tuple(self.vocabulary.split(run, self.outside)))
        self.surfaces = [p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        for value, i in self.bytes.items():
            self.surfaces[i] = bytes([value])
        surface = (spec.trainer_spec.unk_surface or " ⁇ ").encode()
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.CONTROL:
                self.surfaces[i] = b""
            elif p.type == kinds.UNKNOWN:
                self.surfaces[i] = surface
        self.led = {i for i, p in pieces.items() if p.startswith(MARK)} if normal.add_dummy_prefix else set()
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}

    def outside(self, char: str) -> list[int]:
        """A character without a piece: its bytes."""
        return [self.bytes[b] for b in char.encode()]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without begin or end ids; none for an empty text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.memo.__getitem__, self.runs(self.prefix + text.replace(" ", MARK)))))

    def decode(self, ids) -> str:
        """The text of ids; the leading space mark goes, a stray byte becomes U+FFFD."""
        ids = [int(i) for i in ids]
        first = next((i for i in ids if i not in self.silent), None)
        parts, start = [], 0
        for at in [i for i, x in enumerate(ids) if x in self.silent] if not self.silent.isdisjoint(ids) else ():
            parts.append(ids[start:at])  # bytes on both sides of a control id don't join
            start = at + 1
        parts.append(ids[start:])
        out = "".join(b"".join(map(self.surfaces.__getitem__, part)).decode("utf-8", "pipelark-byte-by-byte") for part in parts)
        return out[1:] if first in self.led else out


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    """The codec of a model, built once in a worker."""
    return PieceCodec(model)


def _shipped(df: DataFrame, path: str):
    """The model's bytes (a vocabulary: some MB whatever the corpus) for every worker."""
    with open(path, "rb") as f:
        return ready(df.sparkSession).sparkContext.broadcast(f.read())


def _ids(rows: list[list[int]]) -> pa.Array:
    values, ends = array.array("i"), [0]
    for row in rows:
        values.extend(row)
        ends.append(len(values))
    flat = pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else [], pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the token ids of its texts as ``ids`` (array of int).

    With ``decoded`` there is a column of that name with the text that the ids
    give back, from the same pass over the rows.  Null and empty texts have no
    ids, very long ones are encoded whole.  Rows are kept as they are, repeated
    ones and those with nulls elsewhere included; other columns pass through (``text`` if ``keep_text``), and those
    named like results are replaced.  An empty table gives an empty result.
    """
    model = _shipped(df, model_path)

    def make():
        made = codec(model.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [made.encode(t.as_py() or "") for t in texts]
            back = [pa.array([made.decode(r) for r in rows], pa.string())] if decoded else []
            return [_ids(rows), *back]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return extended(df, text, fields, make, keep_text)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids as ``text``; null ids and no ids give an empty text.

    Long rows of ids are decoded whole.  All rows are kept, repeated ones and those
    with nulls elsewhere included; other columns pass through, one named like the
    result is replaced; an empty table gives an empty result.
    """
    model = _shipped(df, model_path)
    known = [c for c in df.columns if c.lower() != text.lower()]
    schema = T.StructType([*[df.schema[c] for c in known], T.StructField(text, T.StringType())])
    sent = df.select(*[df[f"`{c}`"] for c in known])
    at = [c.lower() for c in known].index(ids.lower())

    def work(batches):
        made = codec(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [made.decode(row.as_py() or ()) for row in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return mapped(sent, work, schema)
