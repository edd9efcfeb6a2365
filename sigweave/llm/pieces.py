"""Operator 12: SentencePiece encoding that keeps byte offsets, and decoding.

A model file holds a vocabulary and a compiled character map: a double-array trie whose keys
are replaced by normal forms.  ``Pieces.normalised`` walks the trie from all characters of a
text at once (numpy), takes the longest key at each place from left to right, and records for
every byte of the result the byte of the source that it came from.  Spaces are folded and
marked as the model says.  The library then segments the normal form (by a copy of the model
whose own normalisation is off), and each piece is projected through the record to the bytes
of the source that it stands for.

``encode`` gives, per row, ``ids`` and ``ends``: piece i covers the source bytes ``ends[i - 1]``
(0 for the first) to ``ends[i]``.  Pieces tile the source.  Of the byte pieces that spell one
unknown character the last has its span, those before are empty; so are pieces that end inside
the normal form of one source character.  ``decode`` gives the library's text of the ids.

Scale.  Both are narrow Arrow stages over whole texts; nothing is shuffled.  A text of more
than ``PIECE`` characters is segmented in parts, cut between two characters that no vocabulary
entry has next to each other, where no piece can cross; so memory follows the part, unless a
text has no such place (one character repeated for megabytes).

Defined cases: a null or empty text has no pieces and decodes to an empty text; repeated rows
are encoded each; bytes that are not UTF-8 count as U+FFFD; extra columns pass through if named
in ``keep``, and made columns get underscores behind their names if they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .session import arrow_batches, fresh

MODEL = "piece_bpe_32k.model"
#: Characters of a long text that are segmented at once, and ids that are decoded at once.
PIECE = 1 << 16
MARK = "▁"
_MARK = MARK.encode()
#: Kinds of vocabulary entries in a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6

_LOADED: dict[str, Pieces] = {}


def model_path(name: str = MODEL) -> str:
    """Place of a public tokenizer file, on whatever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message: integers, or bytes of the others."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """A compiled map: little-endian size of the trie, its 32-bit units, zero-ended normal forms."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4")
        self.forms = compiled[4 + size :]

    def form(self, place: int) -> bytes:
        return self.forms[place : self.forms.index(b"\0", place)]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest key at each start (0: none) and the place of its normal form."""
        length, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive, node = np.arange(len(starts)), np.full(len(starts), self._child(self.units[:1], 0)[0], np.int64)
        depth = 0
        while len(alive):
            at = starts[alive] + depth
            inside = at < len(data)
            alive, node, byte = alive[inside], node[inside], data[at[inside]].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            alive, node, byte = alive[inside], node[inside], byte[inside]
            unit = self.units[node]
            fits = (unit & np.uint32(0x800000FF)) == byte
            alive, unit = alive[fits], unit[fits]
            node = self._child(unit, node[fits])
            depth += 1
            leaf = (unit >> np.uint32(8) & np.uint32(1)) == 1
            length[alive[leaf]] = depth
            place[alive[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, place

    @staticmethod
    def _child(unit: np.ndarray, node: np.ndarray | int) -> np.ndarray:
        shift = (unit & np.uint32(1 << 9)) >> np.uint32(6)
        return node ^ ((unit >> np.uint32(10)) << shift).astype(np.int64)


class Pieces:
    """A SentencePiece model with a normalisation of its own."""

    def __init__(self, serialised: bytes):
        import sentencepiece

        spec: dict[int, int | bytes] = {}
        vocabulary: list[tuple[str, int]] = []
        own = bytearray()
        for number, value in _fields(serialised):
            if number == 3:
                spec = dict(_fields(value))
                continue
            if number == 1:
                entry = dict(_fields(value))
                vocabulary.append((entry[1].decode(), entry.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
                self.space_behind = bool(trainer.get(24, 0))
            own += _field(number, value)
        compiled = spec.get(2, b"")
        self.map = CharacterMap(compiled) if compiled else None
        self.dummy, self.fold, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.kinds = np.array([k for _, k in vocabulary])
        #: Bytes that each entry takes of the normal form.
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in vocabulary])
        self.begins_word = np.array([p.startswith(MARK) for p, _ in vocabulary])
        self.pieces = [p for p, _ in vocabulary]
        fixed = sorted((p for p, k in vocabulary if k == USER_DEFINED), key=len, reverse=True)
        self.fixed = re.compile(b"(?=(" + b"|".join(re.escape(p.encode()) for p in fixed) + b"))") if fixed else None
        self.joined = {a + b for p, k in vocabulary if k != BYTE for a, b in pairwise(p)}
        #: Without byte pieces, unknown characters next to each other are one piece.
        self.known = None if (self.kinds == BYTE).any() else {p for p, _ in vocabulary if len(p) == 1}
        plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=bytes(own) + _field(3, plain))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=serialised)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes, and its end, the byte of ``text`` where its origin starts."""
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return b"", np.zeros(1, np.int32)
        # Units: what one step of longest-prefix replacement consumes; first byte of each, and what it becomes.
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        form, first, source = self._mapped(text, data, starts)
        space = form == 0x20
        kept = np.ones(len(form), bool)
        lead = 0
        if self.fold:
            unit = np.cumsum(first) - 1
            begin = np.flatnonzero(first)
            solid = np.cumsum(~space)
            heading = space & (solid == (solid[begin] - ~space[begin])[unit])  # only spaces before it in its unit
            after = np.concatenate([[True], space[:-1]])[begin][unit]
            kept = ~(heading & after)
            alone = space[begin] & (np.diff(np.append(begin, len(form))) == 1)
            other = np.flatnonzero(~alone)
            if not len(other):
                return b"", np.zeros(1, np.int32)
            lead = int(source[begin[other[0]]]) if other[0] else 0
        form, source, space = form[kept], source[kept], space[kept]
        if self.escape:
            width = np.where(space, len(_MARK), 1)
            source = np.repeat(source, width)
            form = form.tobytes().replace(b" ", _MARK)
        else:
            form = form.tobytes()
        mark = _MARK if self.escape else b" "
        end = len(text)
        if self.dummy and not self.space_behind:
            form, source = mark + form, np.concatenate([np.full(len(mark), lead), source])
        if self.fold:
            while form.endswith(mark):
                end = int(source[len(form) - len(mark)])
                form = form[: -len(mark)]
            source = source[: len(form)]
        if self.dummy and self.space_behind:
            form, source = form + mark, np.concatenate([source, np.full(len(mark), end)])
        return form, np.append(source, end).astype(np.int32)

    def _mapped(self, text: bytes, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after replacement, whether a unit begins there, and where its origin starts in the text."""
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        if self.map is None:
            return data, begins, np.maximum.accumulate(np.where(begins, np.arange(len(data), dtype=np.int32), 0))
        length, place = self.map.longest(data, starts)
        width = np.diff(np.append(starts, len(data)))
        if self.fixed:
            index = {int(s): i for i, s in enumerate(starts.tolist())}
            for m in self.fixed.finditer(text):
                if m.start() in index:
                    length[index[m.start()]], place[index[m.start()]] = len(m[1]), -1
        take = np.where(length > 0, length, width)
        covered, reach = np.zeros(len(starts), bool), -1
        for i in np.flatnonzero(take > width).tolist():  # keys of several characters hide the starts inside them
            if starts[i] >= reach:
                reach = int(starts[i] + take[i])
                covered[i + 1 : np.searchsorted(starts, reach)] = True
        starts, length, place, take = starts[~covered], length[~covered], place[~covered], take[~covered]
        changed = np.flatnonzero((length > 0) & (place >= 0))
        if not len(changed):
            unit = np.zeros(len(data), bool)
            unit[starts] = True
            return data, unit, np.maximum.accumulate(np.where(unit, np.arange(len(data), dtype=np.int32), 0))
        forms = {p: self.map.form(p) for p in np.unique(place[changed]).tolist()}
        pool = np.frombuffer(text + b"".join(forms.values()), np.uint8)
        at = dict(zip(forms, np.cumsum([len(text), *map(len, forms.values())])[:-1].tolist(), strict=True))
        begin, size = starts.copy(), take.copy()
        begin[changed] = [at[p] for p in place[changed].tolist()]
        size[changed] = [len(forms[p]) for p in place[changed].tolist()]
        offset = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(offset, size)
        return pool[np.repeat(begin, size) + inner], inner == 0, np.repeat(starts, size).astype(np.int32)

    def _parts(self, form: str) -> Iterator[str]:
        """A long normal form cut between characters that no entry has next to each other."""
        lo = 0
        while len(form) - lo > PIECE:
            cut = lo + PIECE
            while cut < len(form) and self._inseparable(form[cut - 1], form[cut]):
                cut += 1
            yield form[lo:cut]
            lo = cut
        yield form[lo:]

    def _inseparable(self, a: str, b: str) -> bool:
        return a + b in self.joined or self.known is not None and a not in self.known and b not in self.known

    def ids(self, text: bytes) -> np.ndarray:
        """Ids alone."""
        return np.concatenate([self.plain.encode(part, return_type="numpy") for part in self._parts(self.normalised(text)[0].decode())])

    def encoded(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the end of each piece in the bytes of the text."""
        form, source = self.normalised(text)
        ids, sizes = [], []
        for part in self._parts(form.decode()):
            own = self.plain.encode(part, return_type="numpy")
            size = self.sizes[own]
            if (self.kinds[own] == UNKNOWN).any():  # an unknown stretch is as long as its surface
                size = np.array([len(p.surface.encode()) for p in self.plain.encode(part, return_type="proto").pieces], np.int64)
            ids.append(own)
            sizes.append(size)
        ids, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes), dtype=np.int64)
        return ids, source[ends]

    def decoded(self, ids: np.ndarray) -> str:
        """The library's text of the ids; many ids in parts that begin with a marked space, which is put back."""
        out, lo = [], 0
        while len(ids) - lo > PIECE:
            hit = np.flatnonzero(self.begins_word[ids[lo + PIECE :]])
            cut = lo + PIECE + int(hit[0]) if len(hit) else len(ids)
            out.append(self._text(ids[lo:cut], lo))
            lo = cut
        if lo < len(ids) or not out:
            out.append(self._text(ids[lo:], lo))
        return "".join(out)

    def _text(self, ids: np.ndarray, lo: int) -> str:
        if not lo:
            return self.whole.decode(ids.tolist())
        # An entry without a mark in front keeps the first marked space from being taken for the dummy one.
        guard = self.guard
        return self.whole.decode([guard, *ids.tolist()])[len(self.pieces[guard]) :]

    @property
    def guard(self) -> int:
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds.tolist(), strict=True)):
            if k == 1 and p.isascii() and p.isalnum():
                return i
        raise ValueError("no plain entry in the vocabulary")


def load(path: str) -> Pieces:
    """The model of a file, one per process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Pieces(f.read())
    return _LOADED[path]


def valid(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, U+FFFD for what isn't UTF-8; null gives an empty text."""
    out = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
    try:
        b"\n".join(out).decode()
    except UnicodeDecodeError:
        out = [b.decode("utf-8", "replace").encode() for b in out]
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, model: str = MODEL, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` and ``ends`` of every whole text.  ``model`` names a public file (``model_path``) or a path."""
    arrow_batches(docs.sparkSession)
    kept = docs.select(*keep)
    numbers = ArrayType(IntegerType(), False)
    schema = StructType([*kept.schema, *(StructField(n, numbers, False) for n in fresh(keep, "ids", "ends"))])
    n, names = len(kept.columns), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model if "/" in model else model_path(model))
        for batch in batches:
            made = [own.encoded(t) for t in valid(batch.column(n))]
            lists = [_lists([m[k] for m in made]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *lists], names=names)

    return docs.select(*keep, F.col(text).alias(fresh(keep, "_text")[0])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text that the ids decode to."""
    arrow_batches(encoded.sparkSession)
    (made,) = fresh(encoded.columns, name)
    schema = StructType([*encoded.schema, StructField(made, StringType())])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model if "/" in model else model_path(model))
        for batch in batches:
            column = batch.column(at)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            none = column.is_null().to_numpy(zero_copy_only=False)
            texts = [None if z else own.decoded(flat[a:b]) for z, a, b in zip(none, offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, number and digest of the ids, digest of the decoded text."""
    done = decode(encode(docs, model), model)
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
