"""Secret scans with formats learned by grammar inference.

Three base patterns label credentials (kinds ``assign``, ``access``, ``hex``). For each kind the
labelled values form a prefix tree of symbols; states whose outgoing frequencies are compatible
by the Hoeffding bound, as are the lengths still to come, are merged (red-blue order, the likest
pair first), which gives a deterministic probabilistic automaton. Symbols are characters up to their class, so a format rather than a key is learned.

Candidates are all runs of credential characters outside base spans, of the ``ASSIGN_VALUE``
characters or more that a base value has: each run without separators before and dots after it, what
follows its first and its last equals sign, and its pieces between separators. A candidate's score is its log
likelihood under the best automaton, less that under a background model of all runs' symbol pairs.
Candidates above ``threshold`` become spans of kind ``learned``; of overlapping ones the best stays.

Learning uses at most ``MAX_VALUES`` distinct labelled values of each kind, those that hash
lowest and are no longer than ``MAX_VALUE``; the background counts every run of every text. Texts
are read twice, whole: to learn and to score.

Edge cases: a null text is empty, an empty table gives no rows; texts and runs of any length are
scored whole; equal spans of different kinds are all listed; a kind without ``MIN_VALUES`` labelled
values learns nothing; repeated documents and null ids each keep their row; other columns take no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import map_rows, materialize

#: The base patterns (fixed values), and how long a match (assign: its value) is at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more, as a longest run is found from its start
KINDS = ("assign", "access", "hex", "learned")
ASSIGN_VALUE, ACCESS_MATCH = 6, 20

MAX_VALUE = 512
MAX_VALUES, MIN_VALUES = 2000, 40
ALPHA = 0.1
#: Log likelihood ratio of a credential: odds of one in 665 runs before it is seen.
THRESHOLD = 6.5
#: Log likelihood of a symbol that an automaton doesn't know.
FLOOR = -14.0
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_VALUE)
_PIECE = re.compile(r"[A-Za-z0-9]{%d,}" % ASSIGN_VALUE)
#: Bytes, about, of the verdicts on runs that a worker remembers.
_MEMORY = 64 << 20
_END = "$"


def symbols(value: str) -> str:
    """Classes of a value's characters: d a digit, h a-f, l g-z, F A-F, U G-Z; others stand for themselves."""
    return value.translate(_CLASSES)


_CLASSES = {ord(c): s for s, cs in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("F", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs}


class Automaton:
    """A deterministic probabilistic automaton merged from a prefix tree."""

    def __init__(self, values: Counter, alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, float]] = [{}]
        #: by state: how many values end how many symbols later
        self.tail: list[Counter] = [Counter()]
        for value, n in sorted(values.items()):
            s = 0
            for k, c in enumerate(value):
                self.tail[s][len(value) - k] += n
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.tail.append(Counter())
                self.count[s][c] = self.count[s].get(c, 0) + n
                s = self.next[s][c]
            self.count[s][_END] = self.count[s].get(_END, 0) + n
            self.tail[s][0] += n
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _arrivals(self, s: int) -> float:
        return sum(self.count[s].values())

    def _apart(self, a: int, b: int) -> float:
        """The largest difference between the shares of values of two states that end within so many symbols."""
        na, nb, x, y, out = self._arrivals(a), self._arrivals(b), 0.0, 0.0, 0.0
        for k in sorted(self.tail[a].keys() | self.tail[b].keys()):
            x, y = x + self.tail[a][k] / na, y + self.tail[b][k] / nb
            out = max(out, abs(x - y))
        return out

    def _alike(self, a: int, b: int, apart: float) -> bool:
        """Whether lengths to come, and frequencies of all continuations, of two states are within the Hoeffding bound."""
        if apart > self.bound * (1 / math.sqrt(self._arrivals(a)) + 1 / math.sqrt(self._arrivals(b))):
            return False
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self._arrivals(a), self._arrivals(b)
            if not na or not nb:
                continue
            wide = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > wide:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            self.tail[into].update(self.tail[tree])
            for c, n in self.count[tree].items():
                self.count[into][c] = self.count[into].get(c, 0) + n
            for c, t in self.next[tree].items():
                if c in self.next[into]:
                    todo.append((self.next[into][c], t))
                else:
                    self.next[into][c] = t

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(self._arrivals(t), -t, s, c) for s in red for c, t in self.next[s].items() if t not in known]
            if not blue:
                break
            _, t, s, c = max(blue)
            t = -t
            for apart, _, r in sorted((self._apart(r, t), -self._arrivals(r), r) for r in red):  # the likest first
                if self._alike(r, t, apart):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        place = {s: k for k, s in enumerate(red)}
        self.edges: list[dict[str, tuple[float, int]]] = []
        alphabet = {c for s in red for c in self.count[s]}
        for s in red:
            n = self._arrivals(s) + 0.5 * len(alphabet)
            # a symbol not seen here but elsewhere goes where most go; half a count for each smooths the shares
            most = max(((x, self.next[s][c]) for c, x in self.count[s].items() if c != _END), default=(0, s))[1]
            self.edges.append({c: (math.log((self.count[s].get(c, 0) + 0.5) / n), place[self.next[s].get(c, most)] if c != _END else -1) for c in sorted(alphabet)})
        del self.next, self.count, self.tail

    def score(self, value: str, floor: float = FLOOR) -> float:
        """Log likelihood of the symbols and the end; each symbol that the automaton doesn't know costs ``floor``."""
        s, total = 0, 0.0
        for c in value:
            edge = self.edges[s].get(c)
            if edge is None:
                total += floor
            else:
                total += edge[0]
                s = edge[1]
        return total + self.edges[s][_END][0]


class Background:
    """A smoothed model of symbol pairs over candidates."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs, self.firsts = pairs, Counter()
        for (a, _), n in pairs.items():
            self.firsts[a] += n
        self.size = len({b for _, b in pairs}) + 1

    def score(self, value: str) -> float:
        total, before = 0.0, "^"
        for c in value + _END:
            total += math.log((self.pairs.get((before, c), 0) + 0.5) / (self.firsts.get(before, 0) + 0.5 * self.size))
            before = c
        return total


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base matches, by start and then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MATCH]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def free_runs(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Runs of candidate characters as (start, end), with what base spans cover cut out."""
    out, k, reach = [], 0, 0
    for m in _RUN.finditer(text):
        at = max(m.start(), min(reach, m.end()))
        while k < len(base) and base[k][0] < m.end():
            if base[k][0] - at >= ASSIGN_VALUE:
                out.append((at, base[k][0]))
            at, k = max(at, base[k][2]), k + 1
        reach = max(reach, at)
        if m.end() - at >= ASSIGN_VALUE:
            out.append((at, m.end()))
    return out


def candidates(run: str) -> list[tuple[int, int]]:
    """Parts of a run that are scored, as (start, end)."""
    end = len(run.rstrip("."))
    start = len(run) - len(run.lstrip("+/_.=-"))
    found = {(start, end), (run.find("=", start) + 1, end), (run.rfind("=", start, end) + 1, end)}
    found |= {m.span() for m in _PIECE.finditer(run)}
    return sorted((a, b) for a, b in found if b - a >= ASSIGN_VALUE)


LEARNING = "kind int, value string, a string, b string, n long"


def evidence(docs: DataFrame) -> DataFrame:
    """What there is to learn from: labelled values by kind, and counts of the symbol pairs of runs (columns LEARNING)."""

    def run(rows: dict) -> dict:
        values, forms = set(), Counter()
        for text in rows["text"]:
            if text:
                values.update((k, v) for _, k, _, v in base_spans(text) if len(v) <= MAX_VALUE)
                forms.update(_RUN.findall(text))
        coded: Counter = Counter()
        for form, n in forms.items():
            coded[symbols(form)] += n
        pairs: Counter = Counter()
        for form, n in coded.items():
            for pair in zip("^" + form, form + _END):
                pairs[pair] += n
        own, none = sorted(values), [None] * len(values)
        return {
            "kind": [k for k, _ in own] + [None] * len(pairs), "value": [v for _, v in own] + [None] * len(pairs),
            "a": none + [a for a, _ in pairs], "b": none + [b for _, b in pairs], "n": none + list(pairs.values()),
        }

    return map_rows(docs.select(F.col("text").cast("string").alias("text")), run, LEARNING)


def infer(learning: DataFrame, max_values: int = MAX_VALUES) -> tuple[dict[int, Automaton], Background]:
    """An automaton for each kind with enough labelled values, and the background model."""
    labelled = learning.where("value is not null").select("kind", "value").distinct()
    found: dict[int, Automaton] = {}
    for kind in range(3):
        rows = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(max_values).collect()
        if len(rows) >= MIN_VALUES:
            found[kind] = Automaton(Counter(symbols(r.value) for r in rows))
    # sums by pair of symbols: their number is bounded by the runs' alphabet
    counts = learning.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return found, Background({(r.a, r.b): r.n for r in counts})


class Scorer:
    """Scores of candidates by the models; verdicts on runs are remembered by their symbols."""

    def __init__(self, automata: dict[int, Automaton], background: Background, threshold: float):
        self.automata, self.background, self.threshold = automata, background, threshold
        self.known: dict[str, tuple[tuple[int, int, float], ...]] = {}
        self.held = 0

    def ratio(self, form: str) -> float:
        """The best automaton's log likelihood above the background's."""
        return max((a.score(form) for a in self.automata.values()), default=-math.inf) - self.background.score(form)

    def learned(self, run: str) -> tuple[tuple[int, int, float], ...]:
        """The spans of a run that are credentials, with their scores; the best of those that overlap."""
        form = symbols(run)
        if form in self.known:
            return self.known[form]
        scored = sorted((-self.ratio(form[a:b]), a - b, a, b) for a, b in candidates(form))
        out: list[tuple[int, int, float]] = []  # apart from each other and in order: only the last that begins before b can reach beyond a
        for minus, _, a, b in scored:
            at = bisect_left(out, (b,))
            if -minus > self.threshold and (not at or out[at - 1][1] <= a):
                out.insert(at, (a, b, -minus))
        self.held += len(form) + 64 * (1 + len(out))
        if self.held > _MEMORY:
            self.known.clear()
            self.held = len(form) + 64 * (1 + len(out))
        self.known[form] = tuple(out)
        return self.known[form]

    def spans(self, text: str) -> list[tuple[int, int, int, float | None]]:
        base = base_spans(text)
        out: list[tuple[int, int, int, float | None]] = [(s, k, e, None) for s, k, e, _ in base]
        if any(map(self.learned, set(_RUN.findall(text)))) or base:
            for at, end in free_runs(text, base):
                out += [(at + a, 3, at + b, score) for a, b, score in self.learned(text[at:end])]
        return sorted(out, key=lambda x: x[:3])


SPANS = "doc_id long, spans array<struct<start:int,kind:int,end:int,score:double>>"


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, max_values: int = MAX_VALUES) -> DataFrame:
    """All spans of every document by start, then kind; base spans have no score (columns SPANS)."""
    models = docs.sparkSession.sparkContext.broadcast(infer(materialize(evidence(docs), "secrets-learning"), max_values))
    made: list[Scorer] = []

    def run(rows: dict) -> dict:
        if not made:
            made.append(Scorer(*models.value, threshold))
        return {"doc_id": rows["doc_id"], "spans": [[dict(zip(("start", "kind", "end", "score"), s)) for s in made[0].spans(text or "")] for text in rows["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SPANS)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
