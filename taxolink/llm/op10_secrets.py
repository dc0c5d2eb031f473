"""Operator 10, secret scans with inferred grammars.

Three base patterns find credentials whose form is known.  What they find is the labelled data for one
probabilistic automaton per kind and shape (length and classes of symbols): a prefix tree of the credentials whose states are merged when
their outgoing frequencies are statistically compatible (Hoeffding's bound, as in ALERGIA).  A state that has not seen a symbol falls back on the
symbol's class (digits, lower, upper case, marks), as a random credential may have any symbol of a class.  Every other credential-like run of
characters is then scored by its likelihood per symbol under each automaton and its length's frequency.  A run is added, as a span of kind
``grammar``, if a format explains it as well as it explains credentials that it was not fitted on (the ``QUANTILE`` of scores under
``FOLDS``-fold refits), and ``MARGIN`` better than a model of the corpus's ordinary words does.

A candidate may be as short as the shortest credential of a base pattern.  One that lies within a base span is reported by that
span; all others are scored, also those that contain a base span or overlap its end.

How it runs at scale: one pass over the whole texts yields the distinct credentials and ordinary words with the least hashes, written once as a narrow
table; the models are fitted on at most ``SAMPLE`` distinct values per kind, the ones with the least hashes over all documents;
a second pass over the texts scores all candidates, which are too many to be written.  No text is shuffled.

Null and empty texts have no spans; long ones are read whole, in time linear in the text.  Rows that repeat an id and rows with a null id are rows of
their own.  A shape with fewer than ``MIN_CREDENTIALS`` credentials has no automaton.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import small_batches, staged, table

#: Fixed values of the base patterns: kind, pattern, group that is the credential, its least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = (*(kind for kind, *_ in BASE), "grammar")
#: Runs that may be credentials.
CANDIDATE = rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{min(least for *_, least in BASE)},}}+"
#: Distinct credentials per kind (and ordinary words) that models are fitted on at most, and per shape at least.
SAMPLE, MIN_CREDENTIALS = 600, 8
#: Confidence of the merge test; the quantile of unseen credentials' scores that a candidate must reach, and the refits that give it.
ALPHA, QUANTILE, FOLDS = 0.05, 0.01, 5
#: Log-likelihood by which a format must explain a candidate better than ordinary words do.
MARGIN = math.log(1000)
#: Symbols of a class, and the share of probability that is spread over all symbols.
CLASS_SIZES, SPREAD = {"digit": 10, "lower": 26, "upper": 26, "mark": 6, "": 1}, 0.01
N_SYMBOLS = 68

_ASSIGN = re.compile(BASE[0][1], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(BASE[1][1])
_HEX = re.compile(r"[0-9a-f]{24,}+")  # a greedy run of 24 or more is a run that passes
_CANDIDATE = re.compile(CANDIDATE)
#: Ordinary words: letters, lower-case but for the first.
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z][a-z]{5,}(?![A-Za-z0-9+/_.=-])")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, credential)`` in order of start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidate_spans(text: str, base: Iterable[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters that do not lie within a base span."""
    runs = [(m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(text)]
    # Spans in order of start: of those that begin at or before a run, the farthest end tells whether one covers it.
    spans, at, reach, out = sorted((a, b) for _, a, b, _ in base), 0, 0, []
    for run in runs:
        while at < len(spans) and spans[at][0] <= run[0]:
            reach = max(reach, spans[at][1])
            at += 1
        if run[1] > reach:
            out.append(run)
    return out


def symbol_class(c: str) -> str:
    return "" if not c else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "mark"


class Automaton:
    """A probabilistic deterministic automaton inferred from credentials of one kind."""

    def __init__(self, values: list[str], alpha: float = ALPHA, quantile: float | None = QUANTILE):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # per state: how often each symbol follows; "" is the end
        for value in values:
            state = 0
            for c in value:
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][c]
            self.count[state][""] += 1
        self._merge(alpha)
        self.total = [sum(c.values()) for c in self.count]
        #: Per state: occurrences of each class, the state that its most frequent symbol leads to, and the weight of classes against symbols.
        self.classes: list[Counter] = []
        self.usual: list[dict[str, int]] = []
        for count, follow in zip(self.count, self.next, strict=True):
            by, usual = Counter(), {}
            for c, n in count.most_common():
                by[symbol_class(c)] += n
                if c:
                    usual.setdefault(symbol_class(c), follow[c])
            self.classes.append(by)
            self.usual.append(usual)
        self.back = [len(c) / (n + len(c)) for c, n in zip(self.count, self.total, strict=True)]
        self.length = {n: c / len(values) for n, c in Counter(map(len, values)).items()}
        if quantile is not None:  # scores of values that a refit has not seen
            folds = [[v for i, v in enumerate(values) if i % FOLDS == k] for k in range(FOLDS)]
            unseen = sorted(s for k, fold in enumerate(folds) for s in map(Automaton([v for j, f in enumerate(folds) if j != k for v in f], alpha, None).score, fold))
            self.threshold = unseen[int(quantile * (len(unseen) - 1))]

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the two states' futures have the same frequencies as far as their counts can tell."""
        todo = [(a, b)]
        root = math.sqrt(0.5 * math.log(2 / alpha))
        while todo:
            a, b = todo.pop()
            p, q = self.count[a], self.count[b]
            n, m = sum(p.values()), sum(q.values())
            if not n or not m:
                continue
            bound = root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1 and any(abs(p[c] / n - q[c] / m) > bound for c in p.keys() | q.keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to the automaton at ``into``."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self, alpha: float) -> None:
        """Red states are final, blue ones are their children: each is merged into a compatible red state or becomes red."""
        red = [0]
        while True:
            known = set(red)
            blue = [(a, c, b) for a in red for c, b in sorted(self.next[a].items()) if b not in known]
            if not blue:
                break
            a, c, b = max(blue, key=lambda e: (sum(self.count[e[2]].values()), -e[0], e[1]))
            for r in red:
                if self._compatible(r, b, alpha):
                    self.next[a][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        place = {s: i for i, s in enumerate(red)}
        self.next, self.count = [{c: place[b] for c, b in self.next[s].items()} for s in red], [self.count[s] for s in red]

    def score(self, value: str) -> float:
        """Log-likelihood of the value and its length, per symbol."""
        if len(value) not in self.length:
            return -99.0
        state, total = 0, math.log(self.length[len(value)])
        for c in (*value, ""):
            if state is None:  # no credential of this kind went on like that
                total += math.log(SPREAD / N_SYMBOLS)
                continue
            kind, n, back = symbol_class(c), self.total[state], self.back[state]
            p = (1 - back) * self.count[state][c] / n + back * self.classes[state][kind] / n / CLASS_SIZES[kind] if n else 0.0
            total += math.log((1 - SPREAD) * p + SPREAD / N_SYMBOLS)
            if c:
                state = self.next[state].get(c, self.usual[state].get(kind))
        return total / (len(value) + 1)

    def accepts(self, value: str) -> bool:
        return self.score(value) >= self.threshold


class Ordinary:
    """Frequencies of neighbouring symbols in ordinary words."""

    def __init__(self, words: list[str]):
        self.pair, self.first = Counter(), Counter()
        for w in words:
            for a, b in zip(("", *w), (*w, ""), strict=True):
                self.pair[a, b] += 1
                self.first[a] += 1

    def log_likelihood(self, value: str) -> float:
        """Of the value, or of its lower-cased form if that is likelier: a word in capitals is a word."""
        return max(self._own(value), self._own(value.lower()))

    def _own(self, value: str) -> float:
        return sum(math.log((1 - SPREAD) * self.pair[a, b] / max(1, self.first[a]) + SPREAD / N_SYMBOLS) for a, b in zip(("", *value), (*value, ""), strict=True))


class Grammar:
    """All formats, and the model of what is no credential."""

    def __init__(self, formats: list[Automaton], ordinary: Ordinary):
        self.formats, self.ordinary = formats, ordinary

    def accepts(self, value: str) -> bool:
        scores = [m.score(value) for m in self.formats if m.accepts(value)]
        return bool(scores) and max(scores) * (len(value) + 1) - self.ordinary.log_likelihood(value) >= MARGIN


SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _hash(value: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(value) >> 1


def credentials(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``kind, value, h``: distinct credentials that the base patterns find in ``docs(doc_id, text)``, and ordinary words (kind ``word``), with their
    hashes; of each batch and kind those with the least hashes, so that the least of all are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, set] = defaultdict(set)
            for text in batch.column("text").to_pylist():
                for kind, _, _, value in base_spans(text or ""):
                    found[kind].add(value)
                found["word"].update(_ORDINARY.findall(text or ""))
            rows = [(kind, value, h) for kind, values in found.items() for h, value in nsmallest(sample, ((_hash(v), v) for v in values))]
            kinds, values, hashes = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(hashes, pa.int64())], ["kind", "value", "h"])

    return docs.mapInArrow(run, "kind string, value string, h long").distinct()


def infer(values: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The models of the distinct credentials and words ``values(kind, value, h)``, each from its ``sample`` values of least hash."""
    least = lambda kind: [r["value"] for r in values.where(F.col("kind") == kind).orderBy("h", "value").limit(sample).collect()]
    return grammar_of({kind: least(kind) for kind, *_ in BASE}, least("word"))


def grammar_of(values: dict[str, list[str]], words: list[str]) -> Grammar:
    shapes: dict[tuple, list[str]] = defaultdict(list)
    for kind, found in values.items():
        for v in found:
            shapes[kind, len(v), tuple(sorted(set(map(symbol_class, v))))].append(v)
    return Grammar([Automaton(v) for v in shapes.values() if len(v) >= MIN_CREDENTIALS], Ordinary(words))


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``: arrays of ``(kind, start, end, value)`` for each row of ``docs``."""
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grammar = infer(staged(spark, credentials(docs), "credentials"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            base, added = [], []
            for text in batch.column("text").to_pylist():
                found, kept = base_spans(text or ""), []
                for a, b, value in candidate_spans(text or "", found):
                    if (hit := memo.get(value)) is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        hit = memo[value] = grammar.accepts(value)
                    if hit:
                        kept.append({"kind": "grammar", "start": a, "end": b, "value": value})
                base.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in found])
                added.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, SPAN), pa.array(added, SPAN)], ["doc_id", "base", "added"])

    return docs.mapInArrow(run, f"doc_id long, base {SPANS}, added {SPANS}")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(spark, table(spark, sf_dir, "documents"))
    order = F.expr("transform(array_sort(transform(concat(base, added), s -> struct(s.start as start, array_position(array('assign', 'access', 'hex', 'grammar'), s.kind) as place, s.end as end, s.kind as kind))), s -> struct(s.kind, s.start, s.end))")
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)")
    return got.withColumn("every", order).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"),
    )
