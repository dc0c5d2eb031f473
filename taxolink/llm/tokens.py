"""Tokenizers with a memo: the library encodes each distinct piece of text once per Python worker.

A pre-tokenizer cuts a text into pieces, and a piece's tokens do not depend on its neighbours.  So the tokens of a text
are those of its pieces in order, and only pieces never seen before go to the library, many in one call.
That holds where this module's own splitting is certain to be the library's: for tokenizer files whose normalizer and pre-tokenizer are the
ones that a class knows, in texts without ``UNUSUAL`` code points or a special token's text.  All other texts, and all texts of other tokenizers, go to
the library whole.

The memo lives as long as the Python worker and is emptied when it holds ``MEMO_BYTES``, whatever its entries' sizes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Bytes of one worker's memo, about, and what an entry costs beside its text and value.
MEMO_BYTES, ENTRY_BYTES = 192 << 20, 200
#: Words given to the library in one text.
JOINED = 256
#: Characters of the texts that are cut before any of them is put together.
GROUP = 4_000_000
#: White space, visible ASCII, and letters and marks of Latin, Cyrillic, CJK and Hangul that have been in Unicode unchanged for
#: long, and that no normaliser composes with a neighbour or changes the length of.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-¬®-±´-¸º»¿-įı-ɏЀ-ҁҊ-ԯ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")

#: The ASCII characters that are not unusual, for a test of texts that have no others.
_PLAIN_ASCII = bytes(b for b in range(128) if not UNUSUAL.match(chr(b)))

_OPEN: dict[tuple, object] = {}


def opened(kind: type, path: str):
    """The worker's own object of ``kind`` for the tokenizer at ``path``."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``GROUP`` characters, in order."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= GROUP:
            yield held
            held, n = [], 0
    if held:
        yield held


class Pieces:
    """What both tokenizers share; a subclass says how texts are cut."""

    #: What a chunk is cut into, and what stands between words that are encoded together.
    piece: re.Pattern
    glue: str
    #: The parts of a tokenizer file that decide how it cuts texts, as the patterns here expect them.
    cuts: dict

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks; the library's threads would only add memory
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.known = all(file.get(part) == value for part, value in self.cuts.items()) and not file["model"].get("dropout")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_word(self, piece: str) -> bool:
        """Whether the piece stays one piece when joined to others like it by ``glue``."""
        raise NotImplementedError

    def plain(self, text: str) -> bool:
        if not self.known or any(s in text for s in self.special):
            return False
        return not text.encode().translate(None, _PLAIN_ASCII) if text.isascii() else not UNUSUAL.search(text)

    def _cuts(self, ids: np.ndarray) -> np.ndarray:
        """Where the words of ids that were encoded together end."""
        raise NotImplementedError

    def _marked(self, mark: Callable[[str], bool]) -> np.ndarray:
        """For every id whether its token has a mark."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for token, i in vocabulary.items() if mark(token)]] = True
        return out

    def _encode(self, pieces: list[str]) -> None:
        words = [p for p in pieces if self.is_word(p)]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, raw in zip(groups, self.whole([self.glue.join(g) for g in groups]), strict=True):
            cuts = [0, *(4 * self._cuts(np.frombuffer(raw, "<u4"))).tolist()]
            if len(cuts) == len(group) + 1:
                self.pieces.update((p, raw[a:b]) for p, a, b in zip(group, cuts, cuts[1:], strict=False))
        rest = [p for p in pieces if p not in self.pieces]
        self.pieces.update(zip(rest, self.whole(rest), strict=True))

    def learn(self, texts: list[list[str] | None]) -> None:
        """Put the values of the chunks of all texts into the memo."""
        chunks = set().union(*filter(None, texts))
        fresh = chunks.difference(self.chunks)
        if not fresh:
            return
        if self.held > MEMO_BYTES:
            self.chunks, self.pieces, self.held, fresh = {}, {}, 0, chunks
        cut = {c: self.piece.findall(c) for c in fresh}
        missing = list({p for ps in cut.values() for p in ps if p not in self.pieces})
        if missing:
            self._encode(missing)
        get = self.pieces.__getitem__
        made = {c: b"".join(map(get, ps)) for c, ps in cut.items()}
        self.chunks.update((c, self.value(ids)) for c, ids in made.items())
        self.held += sum(map(len, made)) + sum(map(len, missing)) + 2 * sum(map(len, made.values())) + ENTRY_BYTES * (len(made) + len(missing))

    def value(self, ids: bytes):
        return ids


class WordIds(Pieces):
    """Ids of the lower-casing word tokenizer: white space ends a chunk and is dropped."""

    piece = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    glue = " "
    cuts = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    }

    def __init__(self, path: str):
        super().__init__(path)
        self.last = self._marked(lambda token: token.endswith("</w>"))

    def is_word(self, piece: str) -> bool:
        return piece.isalpha()

    def _cuts(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.last[ids]) + 1

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit bytes."""
        for some in groups(texts):
            cut = [text.lower().split() if self.plain(text) else None for text in some]
            self.learn(cut)
            for text, chunks in zip(some, cut, strict=True):
                yield self.whole([text])[0] if chunks is None else b"".join(map(self.chunks.__getitem__, chunks))


class ByteCounts(Pieces):
    """Token counts of the byte-level tokenizer: white space joins the next word only as one leading space."""

    chunk = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    piece = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
    glue = ""
    cuts = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

    def __init__(self, path: str):
        super().__init__(path)
        self.first = self._marked(lambda token: token.startswith("Ġ"))  # the byte-level letter for a space

    def is_word(self, piece: str) -> bool:
        return piece[0] == " " and piece[1:].isalpha()

    def _cuts(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(self.first[ids]), len(ids))[1:]

    def value(self, ids: bytes) -> int:
        return len(ids) // 4

    def __call__(self, texts: Iterable[str]) -> Iterator[int]:
        for some in groups(texts):
            cut = [self.chunk.findall(text) if self.plain(text) else None for text in some]
            self.learn(cut)
            for text, chunks in zip(some, cut, strict=True):
                yield len(self.whole([text])[0]) // 4 if chunks is None else sum(map(self.chunks.__getitem__, chunks))
