"""SentencePiece BPE encoding and decoding with byte spans of the original text for every piece.

The model file is read here (vocabulary, scores, normaliser rules); its compiled character map, a
double-array trie, is walked for the longest matching prefix at every position, and the source offset of each
normalised character is recorded, so that every piece projects to a span of original UTF-8 bytes.

Merges follow the BPE order: best score first, leftmost among equals. A merge can never bridge two
neighbouring characters that no vocabulary entry holds side by side, so text is cut at such places and
equal segments are encoded once per process and kept in a bounded cache.

Spark's part: texts are encoded batch by batch where they lie; nothing is shuffled. Cases: a null text is
empty; an empty text has no ids; a text of any length is encoded whole; unknown characters become their
UTF-8 bytes (byte fallback) or the unknown piece; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import bounded_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments in one generation of a process's cache; a full one becomes the old one.
CACHE_SEGMENTS = 300_000
#: Longer segments are not kept.
CACHE_CHARS = 48
#: Stands for a pair that no piece joins.
NO_RANK = 1 << 60


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The normaliser's compiled map: a double-array trie over UTF-8 and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(matched bytes, replacement) of the longest entry that begins at ``at``."""
        if not self.units:
            return None
        node, best, k = 0, None, at
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        while k < len(text):
            byte = text[k]
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            k += 1
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = k, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.pool.index(b"\0", best[1])
        return best[0] - at, self.pool[best[1] : end]


@dataclass(frozen=True)
class Piece:
    """A piece of an encoding: its id, its surface, and its span of original UTF-8 bytes."""

    id: int
    piece: str
    start: int
    end: int


class Codec:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if any(kind in (USER, UNUSED) for kind in self.kinds):
            raise ValueError("user-defined and unused pieces are not handled")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.suffix_space = bool(trainer.get(24, 0))
        if self.suffix_space or not self.escape:
            raise ValueError("white space as a suffix, or unescaped, is not handled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.byte_ids = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == BYTE}
        self.byte_fallback = bool(trainer.get(35, 0))
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        #: Places of the pieces in the order of merging; equal scores have equal places.
        order = {score: k for k, score in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {p: order[scores[k]] for p, k in self.ids.items()}
        self.id_texts = {p: str(k) for p, k in self.ids.items()}
        #: Neighbouring characters that some piece holds: only between these can a merge take place.
        self.bonds = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    # -- normalisation ----------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters (and its end) the original byte offset."""
        if not self.map.units and not self.squeeze:
            out = text.replace(" ", SPACE)
            offsets, at = [], 0
            for ch in text:
                offsets.append(at)
                at += 1 if ch < "\x80" else 2 if ch < "ࠀ" else 3 if ch < "\U00010000" else 4
            offsets.append(at)
        else:
            out, offsets = self._mapped(text.encode("utf-8", "replace"))
        if out and self.dummy_prefix:
            out, offsets = SPACE + out, [offsets[0], *offsets]
        return out, offsets

    def _mapped(self, raw: bytes) -> tuple[str, list[int]]:
        chars: list[str] = []
        offsets: list[int] = []
        at = 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            width = found[0] if found else 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
            for ch in (found[1] if found else raw[at : at + width]).decode("utf-8", "replace"):
                if ch == " " and self.squeeze and (not chars or chars[-1] == SPACE):
                    continue
                chars.append(SPACE if ch == " " else ch)
                offsets.append(at)
            at += width
        end = len(raw)
        while self.squeeze and chars and chars[-1] == SPACE:
            chars.pop()
            end = offsets.pop()
        return "".join(chars), [*offsets, end]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The same as ``normalise`` with the offsets as an array."""
        if self.map.units or self.squeeze:
            out, offsets = self.normalise(text)
            return out, np.asarray(offsets, np.int64)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        offsets = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        out = text.replace(" ", SPACE)
        if out and self.dummy_prefix:
            out, offsets = SPACE + out, np.append(offsets[:1], offsets)
        return out, offsets

    # -- merging ----------------------------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """Normalised text cut where no merge can cross; coarse cuts before words, whole and in order."""
        # a run of spaces begins a segment: no piece holds a space after another character
        if self._space_leads():
            parts = text.split(SPACE)
            if "" not in parts[1:]:
                whole = [SPACE + part for part in parts[1:]]
                return [parts[0], *whole] if parts[0] else whole
            out = [parts[0]] if parts[0] else []
            run = 0
            for part in parts[1:]:
                run += 1
                if part:
                    out.append(SPACE * run + part)
                    run = 0
            if run:
                out.append(SPACE * run)
            return out
        return [text] if text else []

    @cache  # noqa: B019  one codec lives as long as its process
    def _space_leads(self) -> bool:
        return not any(bond[1] == SPACE and bond[0] != SPACE for bond in self.bonds)

    def merge(self, segment: str) -> list[str]:
        """The pieces of one segment."""
        bonds, out, first = self.bonds, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in bonds:
                out += self._merged(segment[first:k])
                first = k
        return out + self._merged(segment[first:])

    def _merged(self, word: str) -> list[str]:
        n = len(word)
        if n < 2:
            return [word] if word else []
        if n > 64:
            return self._merged_long(word)
        rank, parts = self.rank.get, list(word)
        pairs = [rank(pair, NO_RANK) for pair in map(str.__add__, parts, parts[1:])]
        last = n - 1  # number of pairs
        while last and (best := min(pairs)) != NO_RANK:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            last -= 1
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < last:
                pairs[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        """The same for a long segment: a heap of pairs over a linked list."""
        from heapq import heapify, heappop, heappush

        rank, parts = self.rank.get, list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for k in range(n - 1):
            value = rank(parts[k] + parts[k + 1])
            if value is not None:
                heap.append((value, k, parts[k] + parts[k + 1]))
        heapify(heap)
        while heap:
            _, k, whole = heappop(heap)
            j = after[k]
            if not parts[k] or j < 0 or parts[k] + parts[j] != whole:
                continue
            parts[k], parts[j] = whole, ""
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0:
                    value = rank(parts[a] + parts[b])
                    if value is not None:
                        heappush(heap, (value, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    # -- encoding and decoding --------------------------------------------------------------------

    def encode(self, text: str | None) -> list[Piece]:
        """Pieces with their original byte spans (a fallback byte spans its whole character)."""
        normal, offsets = self.normalise(text or "")
        out, at = [], 0
        for segment in self.segments(normal):
            for piece in self.merge(segment):
                span = offsets[at], offsets[at + len(piece)]
                at += len(piece)
                out += [Piece(k, self.pieces[k] if self.kinds[k] != UNKNOWN else piece, *span) for k in self._ids([piece])]
        return out

    def encode_ids(self, text: str | None) -> list[int]:
        return [k for segment in self.segments(self.normalise(text or "")[0]) for k in self._ids(self.merge(segment))]

    @cache  # noqa: B019
    def _surfaces(self) -> list[str | None]:
        """Texts of the ids; a fallback byte of 128 or more is a lone surrogate, and what has no text of its own is None."""
        byte = lambda p: bytes([int(p[3:5], 16)]).decode("utf-8", "surrogateescape")
        return [p.replace(SPACE, " ") if kind == NORMAL else byte(p) if kind == BYTE else None for p, kind in zip(self.pieces, self.kinds)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces restored, fallback bytes joined, and the leading dummy space gone."""
        if not self.squeeze and ids:
            surfaces = self._surfaces()
            try:
                text = "".join([surfaces[k] for k in ids])
                if self.dummy_prefix and self.kinds[ids[0]] == NORMAL and text.startswith(" "):
                    text = text[1:]
                return text.encode("utf-8", "surrogateescape").decode()
            except (TypeError, UnicodeError):
                pass  # an id without text of its own, or bytes that are no characters
        out: list[str] = []
        pending = bytearray()
        at_start = self.dummy_prefix or self.squeeze
        for k in [*ids, -1]:
            if k >= 0 and self.kinds[k] == BYTE:
                pending.append(int(self.pieces[k][3:5], 16))
                continue
            if pending:
                out.append(_bytes_text(bytes(pending)))
                pending.clear()
                at_start = False
            if k < 0 or self.kinds[k] == CONTROL:
                continue
            piece = self.unknown_surface if self.kinds[k] == UNKNOWN else self.pieces[k]
            if at_start and piece.startswith(SPACE):
                piece = piece[1:]
                at_start = self.squeeze and not piece
            else:
                at_start = False
            out.append(piece if self.kinds[k] == UNKNOWN else piece.replace(SPACE, " "))
        return "".join(out)


def _bytes_text(raw: bytes) -> str:
    """Fallback bytes as text; every byte that is no part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
            except UnicodeDecodeError:
                continue
            at += width
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def codec(path: str) -> Codec:
    """The codec of a model file, read once per process."""
    with open(path, "rb") as file:
        return Codec(file.read())


class CachedEncoder:
    """Encodes whole texts with spans, through a bounded cache of segments and of their parts, in two generations.

    A segment is kept as one 32-bit number an id: the id, and in the top byte the characters after which the next id begins (0
    for all but the last byte of a character that falls back to bytes). Sums of these are every id's place in the text.
    """

    def __init__(self, of: Codec):
        if len(of.pieces) >> 24 or max(map(len, of.ids)) > 255:
            raise ValueError("too many or too long pieces")
        self.codec = of
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = [str(k) for k in range(len(of.pieces))]
        self.numbers = {p: (k | len(p) << 24).to_bytes(4, "little") for p, k in of.ids.items()}

    def _kept(self, segment: str, found: bytes) -> bytes:
        if len(segment) <= CACHE_CHARS:
            if len(self.young) >= CACHE_SEGMENTS:
                self.old, self.young = self.young, {}
            self.young[segment] = found
        return found

    def _segment(self, segment: str) -> bytes:
        found = self.young.get(segment)
        if found is None:
            found = self.old.get(segment)
            if found is None:
                found = self._whole(segment) if segment[1:].isalpha() else self._parts(segment)
            self._kept(segment, found)
        return found

    def _whole(self, segment: str) -> bytes:
        of, out = self.codec, []
        for piece in of.merge(segment) if len(segment) > 24 else of._merged(segment):
            number = self.numbers.get(piece)
            if number is None:
                ids = of._ids([piece])
                number = b"".join([(k | (len(piece) if at == len(ids) else 0) << 24).to_bytes(4, "little") for at, k in enumerate(ids, 1)])
            out.append(number)
        return b"".join(out)

    def _parts(self, segment: str) -> bytes:
        """The same, part by part between places that no merge crosses."""
        bonds, young, old, first, out = self.codec.bonds, self.young.get, self.old.get, 0, []
        for k, pair in enumerate([*map(str.__add__, segment, segment[1:]), ""], 1):
            if pair not in bonds:
                part = segment[first:k]
                first = k
                out.append(young(part) or old(part) or self._kept(part, self._whole(part)))
        return b"".join(out)

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and the first and the end byte of each id's span of the original text."""
        of = self.codec
        normal, offsets = of.aligned(text or "")
        get, miss = self.young.get, self._segment
        packed = np.frombuffer(b"".join([get(s) or miss(s) for s in of.segments(normal)]), np.uint32)
        ids, steps = packed & 0xFFFFFF, (packed >> 24).astype(np.int64)
        ends = np.cumsum(steps)
        starts = ends - steps
        ends = np.maximum(ends, starts + 1)  # all bytes of a character have its span
        if not of.byte_fallback and len(ids):
            # neighbouring unknown pieces are one
            goes_on = (ids[1:] == of.unknown) & (ids[:-1] == of.unknown)
            ids, starts, ends = ids[np.append(True, ~goes_on)], starts[np.append(True, ~goes_on)], ends[np.append(~goes_on, True)]
        return ids, offsets[starts], offsets[ends]

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, text decoded from these ids), from the pieces with their spans."""
        ids, starts, _ = self.spans(text)
        listed, names = ids.tolist(), self.names
        return len(starts), ",".join([names[k] for k in listed]), self.codec.decode(listed)


@cache
def encoder(path: str) -> CachedEncoder:
    """The encoder of a model file: its caches serve all tasks of a process."""
    return CachedEncoder(codec(path))


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_PIECES = "array<struct<id:int,piece:string,start:long,end:long>>"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``pieces``: every piece with its id and original byte span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, spans = codec(model_path), encoder(model_path).spans
        kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                surface = lambda i, a, b: of.pieces[i] if of.kinds[i] != UNKNOWN else raw[a:b].decode("utf-8", "replace")
                pieces = [{"id": i, "piece": surface(i, a, b), "start": a, "end": b} for i, a, b in zip(*(x.tolist() for x in spans(text)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([pieces], kind)], names=[id_col, "pieces"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pieces {_PIECES}")


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path).encode
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                n, ids, decoded = encode(value.as_py())
                counts.append(n)
                ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hex.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], schema=_ROWS)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 32k BPE model."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
