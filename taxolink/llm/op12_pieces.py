"""Operator 12, SentencePiece encoding and decoding with byte spans of the original text.

A model file is read here: its pieces, its normalizer's settings and the compiled character map, a double array over UTF-8 bytes with a table of
replacements.  A text is normalised from left to right by the longest prefix that the map has (a character without one stays), and each normalised
character records the byte of the original text that it comes from.  Normalised text is cut where no piece of the vocabulary can reach across, each distinct chunk is
encoded once per Python worker by the library (whose own normalizer is switched off), and the pieces' lengths project every piece to a span of
original bytes.  Decoding joins the pieces, puts bytes together to characters, and turns piece marks into spaces.

How it runs at scale: one pass over the rows, no shuffle.  The memo of chunks is emptied when it holds ``MEMO_BYTES``.  A model for which chunks are not safe (pieces
that go on behind a space mark, user-defined symbols, no byte fallback, space marks as suffixes) encodes whole normalised texts.

Null and empty texts have no ids and decode to the empty text; long ones are read whole; rows that repeat an id, and rows with a null id, are rows of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import small_batches, table
from taxolink.llm.tokens import opened

MARK = "▁"
#: Bytes of one worker's memo, about, and what an entry costs beside its texts.
MEMO_BYTES, ENTRY_BYTES = 192 << 20, 400
#: Fixed values of the model file's format: kinds of pieces, and the numbers of the fields that are read.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, KIND = 1, 3
CHARMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
AS_SUFFIX, BYTE_FALLBACK, UNKNOWN_SURFACE = 24, 35, 44


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a message's fields: integers, or bytes for all else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


def field(number: int, value: int | bytes) -> bytes:
    """A message with one field; an integer must be below 128."""
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    return varint(number << 3) + bytes([value]) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """The compiled map: what the longest known prefix of a text becomes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.first = self._first_bytes()

    def _first_bytes(self) -> re.Pattern | None:
        """Matches where a known prefix may begin: by its first byte, and the second one where the first alone is not known."""
        known = lambda node: [b for b in range(1, 256) if (node ^ b) < len(self.units) and self.units[node ^ b] & 0x800000FF == b]
        one_of = lambda bs: b"[" + b"".join(re.escape(bytes([b])) for b in bs) + b"]"
        if not self.units:
            return None
        root, short, long = self._child(0), [], []
        for b in known(root):
            at = root ^ b
            if self.units[at] >> 8 & 1:
                short.append(b)
            elif more := known(self._child(at)):
                long.append(re.escape(bytes([b])) + b"(?=" + one_of(more) + b")")
        options = ([one_of(short)] if short else []) + long
        return re.compile(b"|".join(options)) if options else None

    def _child(self, unit_at: int) -> int:
        unit = self.units[unit_at]
        return unit_at ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """``(end, replacement)`` of the longest prefix known at byte ``at``."""
        node, found = self._child(0), None
        for end in range(at, len(raw)):
            node ^= raw[end]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[end]:
                break
            has_value = self.units[node] >> 8 & 1
            node = self._child(node)
            if has_value:
                found = end + 1, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])


def char_starts(text: str) -> np.ndarray:
    """The first byte of every character in UTF-8, and the number of bytes at the end."""
    point = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), dtype=np.int64)])


class Model:
    """A model file, opened in a worker."""

    def __init__(self, path_or_bytes: str | bytes):
        import sentencepiece

        raw = path_or_bytes
        if isinstance(raw, str):
            with open(raw, "rb") as f:
                raw = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for n, value in fields(raw):
            if n == PIECES:
                one = dict(fields(value))
                pieces.append((one.get(PIECE, b"").decode(), one.get(KIND, NORMAL)))
            elif n == TRAINER:
                trainer |= dict(fields(value))
            elif n == NORMALIZER:
                normalizer |= dict(fields(value))
        self.map = CharacterMap(normalizer.get(CHARMAP, b""))
        self.dummy, self.trim, self.escape = (bool(normalizer.get(k, 1)) for k in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE))
        self.suffix, self.unknown = bool(trainer.get(AS_SUFFIX, 0)), trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode()).decode()
        self.pieces, self.kinds = [p for p, _ in pieces], [k for _, k in pieces]
        self.user = sorted((p for p, k in pieces if k == USER), key=len, reverse=True)
        # The library reads normalised text: an appended message overrides the settings of the file's own.
        off = field(CHARMAP, b"") + field(DUMMY_PREFIX, 0) + field(EXTRA_SPACES, 0) + field(ESCAPE, 0)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw + field(NORMALIZER, off))
        long = [p for p, k in pieces if k == NORMAL and len(p) > 1]
        self.cut = None
        if trainer.get(BYTE_FALLBACK) and not self.suffix and not self.user and not any(MARK in p.lstrip(MARK) for p in long):
            inside = set().union(*long) if long else set()
            alone = "".join(re.escape(c) for c in "\t\n\x0b\x0c\r" if c not in inside)
            self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.memo: dict[str, tuple[bytes, int, bytes, str]] = {}
        self.held = 0

    # -- normalisation

    def _mapped(self, text: str) -> tuple[str, np.ndarray, int]:
        """``text`` through the map, the original byte of each character of the result (one more for the end), and the byte behind leading spaces."""
        starts = char_starts(text)
        if not self.map.first and not self.user:
            return text, starts, len(text) - len(text.lstrip(" "))
        raw, out, offsets, at, begin = text.encode(), [], [], 0, None
        while at < len(raw):
            word = next((u for u in self.user if raw.startswith(u.encode(), at)), None)
            hit = None if word else self.map.longest(raw, at) if self.map.units else None
            if word:  # stays as it is
                end, new = at + len(word.encode()), word
            elif hit:
                end, new = hit[0], hit[1].decode()
            else:
                end = at + 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                new = raw[at:end].decode()
            out.append(new)
            offsets.append(np.full(len(new), at, np.int64))
            if begin is None and new != " ":
                begin = at
            at = end
            if not self.user:  # on to the next byte with which a known prefix begins
                found = self.map.first.search(raw, at)
                stop = found.start() if found else len(raw)
                plain = raw[at:stop].decode()
                out.append(plain)
                offsets.append(char_starts(plain)[:-1] + at)
                if begin is None and plain.strip(" "):
                    begin = at + len(plain) - len(plain.lstrip(" "))
                at = stop
        return "".join(out), np.concatenate([*offsets, [len(raw)]]), len(raw) if begin is None else begin

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with space marks, and the original byte of each of its characters (one more for the end)."""
        if not text:
            return "", np.zeros(1, np.int64)
        out, origin, begin = self._mapped(text)
        mark = MARK if self.escape else " "
        if self.trim and out:
            space = np.frombuffer(out.encode("utf-32-le"), "<u4") == 32
            kept = ~space | np.append([False], ~space[:-1])  # the first of several spaces, but none at the beginning
            out, origin = "".join(c for c, k in zip(out, kept.tolist(), strict=True) if k), np.append(origin[:-1][kept], origin[-1])
        if not out:
            return "", np.zeros(1, np.int64)
        out = out.replace(" ", mark)
        if self.dummy and not self.suffix:
            out, origin = mark + out, np.append(begin if self.trim else 0, origin)
        if self.trim:  # all marks at the end, whatever they were
            out = out.rstrip(mark)
            origin = origin[: len(out) + 1]
        if self.dummy and self.suffix:
            out, origin = out + mark, np.append(origin, origin[-1])
        return out, origin

    # -- encoding

    def surface(self, i: int) -> str:
        return self.pieces[i] if self.kinds[i] != BYTE else ""

    def _lengths(self, chunk: str, ids: Sequence[int]) -> list[int]:
        """Normalised characters that each id stands for; of the ids of a character's bytes the last one has it."""
        out, at = [], 0
        for n, i in enumerate(ids):
            if self.kinds[i] == BYTE:
                more = n + 1 < len(ids) and self.kinds[ids[n + 1]] == BYTE and int(self.pieces[ids[n + 1]][3:5], 16) & 0xC0 == 0x80
                out.append(0 if more else 1)
            elif self.kinds[i] == UNKNOWN:  # all characters up to the next known piece
                rest = len(chunk) if n + 1 == len(ids) else chunk.index(self.surface(ids[n + 1]) or chunk[at + 1], at + 1)
                out.append(rest - at)
            else:
                out.append(len(self.pieces[i]))
            at += out[-1]
        return out

    def _entry(self, chunk: str, ids: Sequence[int]) -> tuple[bytes, int, bytes, str]:
        return ",".join(map(str, ids)).encode(), len(ids), np.array(self._lengths(chunk, ids), "<u4").tobytes(), self.joined(ids)

    def entries(self, normal: str) -> list[tuple[bytes, int, bytes, str]]:
        """For each chunk of a normalised text: its ids as text, their number, their lengths, and what they decode to before marks become spaces."""
        if not normal:
            return []
        if self.cut is None:
            return [self._entry(normal, self.library.encode(normal))]
        chunks = self.cut.findall(normal)
        fresh = [c for c in set(chunks) if c not in self.memo]
        if fresh:
            if self.held > MEMO_BYTES:
                self.memo, self.held, fresh = {}, 0, list(set(chunks))
            for c, ids in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True):
                e = self.memo[c] = self._entry(c, ids)
                self.held += 2 * len(c) + len(e[0]) + len(e[2]) + 2 * len(e[3]) + ENTRY_BYTES
        return list(map(self.memo.__getitem__, chunks))

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids of a text, and for each of them the bytes ``[begin, end)`` of the text that it stands for."""
        normal, origin = self.normalise(text)
        parts = self.entries(normal)
        spans = self.spans(parts, origin)
        return [int(i) for e in parts if e[1] for i in e[0].split(b",")], list(map(tuple, spans.tolist()))

    @staticmethod
    def spans(parts: list[tuple[bytes, int, bytes, str]], origin: np.ndarray) -> np.ndarray:
        ends = np.cumsum(np.frombuffer(b"".join([e[2] for e in parts]), "<u4"), dtype=np.int64)
        at = origin[np.append([0], ends)] if len(ends) else np.zeros(1, np.int64)
        return np.stack([at[:-1], at[1:]], 1)

    # -- decoding

    def _surfaces(self, ids: Sequence[int]) -> Iterator[str]:
        """What the ids stand for, bytes put together; space marks stay."""
        held = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                yield decoded_bytes(bytes(held))
                held.clear()
            if kind != CONTROL:
                yield self.unknown if kind == UNKNOWN else self.pieces[i]
        if held:
            yield decoded_bytes(bytes(held))

    def joined(self, ids: Sequence[int]) -> str:
        return "".join(self._surfaces(ids))

    def plain(self, joined: str) -> str:
        """Joined pieces without the mark that normalisation put before them, with spaces for marks."""
        if self.dummy and joined.startswith(MARK):
            joined = joined[1:]
        return joined.replace(MARK, " ")

    def decode(self, ids: Sequence[int]) -> str:
        if not self.trim:
            return self.plain(self.joined(ids))
        out = ""
        rest = self._surfaces(ids)
        for one in rest:  # every piece loses a mark until there is a text
            out = one.removeprefix(MARK)
            if out:
                break
        return "".join([out, *rest]).replace(MARK, " ")


def decoded_bytes(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that is part of no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for width in range(1, 5):
                try:
                    out.append(raw[at : at + width].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                width = 1
            at += width
        return "".join(out)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, begins, ends, decoded`` of every row: piece ids, their spans of original bytes, and the decoded text."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(Model, model)
        for batch in batches:
            got = [m.encode(t or "") for t in batch.column(1).to_pylist()]
            lists = [[ids for ids, _ in got], [[a for a, _ in s] for _, s in got], [[b for _, b in s] for _, s in got]]
            arrays = [batch.column(0), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int32(), pa.int64(), pa.int64()), strict=True)), pa.array([m.decode(ids) for ids, _ in got])]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, begins array<long>, ends array<long>, decoded string")


def piece_digests(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as digests, without lists of ids: ``id, n_tokens, ids_sha256, decoded_sha256, spans_crc32`` (of all begins and ends as 64-bit integers)."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(Model, model)
        for batch in batches:
            n, ids, decoded, spans = [], [], [], []
            for text in batch.column(1).to_pylist():
                normal, origin = m.normalise(text or "")
                parts = m.entries(normal)
                n.append(sum([e[1] for e in parts]))
                ids.append(hashlib.sha256(b",".join([e[0] for e in parts if e[1]])).hexdigest())
                text = m.plain("".join([e[3] for e in parts])) if not m.trim else m.decode([int(i) for e in parts for i in e[0].split(b",")])
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                spans.append(zlib.crc32(m.spans(parts, origin).astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(spans, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of ``documents``, as digests."""
    return piece_digests(spark, table(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))
