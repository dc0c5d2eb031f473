"""Operator 12 against the sentencepiece library: ids, spans and decoded texts, with and without a compiled character map."""

import hashlib
import random

import pytest
import sentencepiece

from taxolink.llm import op12_pieces as o12

MODEL = o12.model_path("piece_bpe_32k.model")
ALPHABET = [*"abcdeABC  \n\t.,;:!?0123456789'\"-_/", "the ", " of", "tion", "  ", "   ", "▁", "é", "é", "ß", "½", "ﬁ", "漢", "字", "한", "α", "ж", "😀", "👩‍👩‍👧", " ", "​", "　", "\x00", "\x7f", "<s>", "</s>", "<unk>", "<0x0A>", "ａ", "①"]


def texts(n, seed, longest=60):
    r = random.Random(seed)
    yield from ("", " ", "  ", "\n", "▁", "▁▁ ▁", " a", "a ", "<s>", "\x00")
    for _ in range(n):
        yield "".join(r.choice(ALPHABET) for _ in range(r.randint(1, longest)))


def spans_of(library, text):
    """The library's spans, in bytes."""
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def double_array(words: dict[bytes, int]) -> bytes:
    """A small compiled trie, for tests: values of keys, units of 32 bits."""
    units, bases = {0: 0}, set()

    def place(at: int, keys: list[bytes], depth: int) -> None:
        labels = sorted({k[depth] if depth < len(k) else 0 for k in keys})
        base = next(b for b in range(1, 1 << 20) if b not in bases and all((b ^ c) not in units and (b ^ c) for c in labels))
        bases.add(base)
        units[at] = units.get(at, 0) | (at ^ base) << 10 | ((labels[0] == 0) << 8)
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            below = [k for k in keys if (k[depth] if depth < len(k) else 0) == c]
            if c:
                place(base ^ c, below, depth + 1)
            else:
                units[base] = words[below[0]] | 1 << 31

    place(0, sorted(words), 0)
    size = -(-(max(units) + 256) // 256) * 256
    def unused(i: int) -> int:  # a label that no node of these 256 units takes for its own
        return i & 255 ^ next(u for u in range(256) if i & ~255 | u not in bases)

    return b"".join((units[i] if i in units else unused(i)).to_bytes(4, "little") for i in range(size))


def with_map(mapping: dict[str, str], **settings: int) -> bytes:
    texts_, places = b"", {}
    for source, target in mapping.items():
        places[source.encode()] = len(texts_)
        texts_ += target.encode() + b"\0"
    trie = double_array(places)
    spec = o12.field(o12.CHARMAP, len(trie).to_bytes(4, "little") + trie + texts_)
    for name, value in settings.items():
        spec += o12.field(getattr(o12, name), value)
    with open(MODEL, "rb") as f:
        return f.read() + o12.field(o12.NORMALIZER, spec)


@pytest.mark.parametrize("variant", ["file", "no prefix", "trim", "map", "map and trim"])
def test_same_as_library(variant):
    mapping = {"ﬁ": "fi", "é": "é", "½": "1⁄2", " ": " ", "　": " ", "ａ": "a", "①": "1", "ab": "b", "abc": "XYZ", "​": "", "\t": " "}
    raw = {
        "file": lambda: open(MODEL, "rb").read(),
        "no prefix": lambda: open(MODEL, "rb").read() + o12.field(o12.NORMALIZER, o12.field(o12.DUMMY_PREFIX, 0)),
        "trim": lambda: open(MODEL, "rb").read() + o12.field(o12.NORMALIZER, o12.field(o12.EXTRA_SPACES, 1)),
        "map": lambda: with_map(mapping),
        "map and trim": lambda: with_map(mapping, EXTRA_SPACES=1),
    }[variant]()
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=raw), o12.Model(raw)
    for text in texts(3000, variant):
        ids, spans = mine.encode(text)
        assert ids == library.encode(text), repr(text)
        assert mine.decode(ids) == library.decode(ids), repr(text)
        assert spans == spans_of(library, text), repr(text)


def test_decode_of_any_ids():
    """Also of ids that no text gives: broken bytes, controls, unknowns."""
    library, mine, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), o12.Model(MODEL), random.Random(5)
    for _ in range(5000):
        ids = [r.choice([r.randrange(3), r.randrange(3, 259), r.randrange(130, 259), r.randrange(259, 32_000)]) for _ in range(r.randint(0, 12))]
        assert mine.decode(ids) == library.decode(ids), ids


def test_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(o12, "MEMO_BYTES", 2000)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), o12.Model(MODEL)
    for text in texts(500, 8):
        assert mine.encode(text)[0] == library.encode(text)


def test_query(spark, sf_dir):
    """Every document, by the library alone."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = o12.op12_piece_codec(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids, a further column of a name used inside, an empty table."""
    rows = [(None, "a b"), (1, None), (1, ""), (2, "word " * 50_000), (2, "word " * 50_000), (3, "▁ ▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as ids", "doc_id", "text", "'x' as decoded")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((r["doc_id"] or 0, r["ids"], r["decoded"], r["ends"][-1:]) for r in o12.encode_pieces(spark, docs, MODEL).collect())
    want = sorted((i or 0, library.encode(t or ""), library.decode(library.encode(t or "")), [len(t.encode())] if t else []) for i, t in rows)
    assert got == want
    assert o12.piece_digests(spark, docs.limit(0), MODEL).count() == 0
    assert sorted(r["n_tokens"] for r in o12.piece_digests(spark, docs, MODEL).collect()) == sorted(len(w[1]) for w in want)
