"""Secrets by grammar inference: probabilistic automata of credential formats score every candidate.

One pass over the whole texts finds base spans (fixed rules that always stay; their values are the labelled credentials)
and candidates: runs of credential characters of at least ``LEAST`` with something else than letters among them. Distinct
labelled values of each kind, and candidates that touch no base span, give a prefix tree each. Its states
count visits, ends and symbols; those that are too rare to be told apart are pooled by depth and class of the last symbol, and states
whose ends and symbols, and those of all that follows, agree within Hoeffding's bound are merged. What results is a
probabilistic automaton; lengths, fixed prefixes and alphabets survive in it where the data tells them apart. Every candidate is scored by all
automata, and is added where the posterior of a kind, with the exact counts of kinds and candidates as
priors, reaches ``ACCEPT``.

Defined cases: null text is the empty text; very long texts are read whole, in time that grows with their length; candidates that touch a base span
are not added, of equally likely kinds the first is named; rows that repeat are reported each; null ``doc_id`` stays null; an empty table
gives an empty result, a kind without labelled values adds nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, texts, texts_of

KINDS = ("assign", "access", "hex")
#: The kind of candidates that touch no base span.
ORDINARY = len(KINDS)

# Fixed patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{8,}")
LEAST = 8
#: What stands around a credential in a sentence.
AROUND = ".-/"

#: Labelled values, and candidates, of each kind that an automaton is inferred from: distinct ones of least hash. Longer ones than LONGEST don't teach; they are scored.
SAMPLE, LONGEST = 2048, 256
#: Visits below which a state is pooled with others, the error of Hoeffding's bound, and the weight of the uniform distribution in a state.
RARE, ALPHA, SMOOTH = 16, 0.05, 1.0
ACCEPT = 0.9
#: How often the ordinary candidates are inferred again, at most.
ROUNDS = 4


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base rules, sorted."""
    out = []
    low = data.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Base spans, and candidates (start, end) that touch none."""
    base = base_spans(text, data)
    starts, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        if m[0].isalpha():
            continue
        value = m[0].lstrip(AROUND)
        a = m.end() - len(value)
        b = a + len(value.rstrip(AROUND))
        before = bisect_left(starts, b)  # base spans that begin before b
        if b - a >= LEAST and not text[a:b].isalpha() and not (before and ends[before - 1] > a):
            out.append((a, b))
    return base, out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, start array<long>, kind array<int>, end array<long>, value array<string>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of its base spans, and base spans and candidates with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in slices(batches, "text"):
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                text = data.decode("utf-8", "replace")
                base, more = scan(text, data)
                kinds = [k for _, k, _, _ in base]
                spelled = spell([x[:3] for x in base])
                rows = [(a, k, b, text[v:b]) for a, k, b, v in base] + [(a, ORDINARY, b, text[a:b]) for a, b in more]
                out.append((doc, *(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(spelled.encode()).hexdigest(), *([list(x) for x in zip(*rows, strict=True)] or [[]] * 4)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, FOUND)


@dataclass
class State:
    """Visits, ends, and how often each symbol follows and where it leads."""

    visits: int = 0
    ends: int = 0
    counts: Counter = field(default_factory=Counter)
    to: dict[str, int] = field(default_factory=dict)


def symbol_class(symbol: str) -> str:
    return "A" if symbol.isupper() else "a" if symbol.islower() else "0" if symbol.isdigit() else symbol


def prefix_tree(values: list[str], rare: int = RARE) -> list[State]:
    """The prefix tree of values, depth by depth; states with fewer than ``rare`` visits are pooled by depth and the class of the symbol that leads to them."""
    states = [State()]
    layer: list[tuple[int, list[str]]] = [(0, values)]
    depth = 0
    while layer:
        pools: dict[str, list[str]] = defaultdict(list)
        arrows: list[tuple[int, str, str]] = []  # from rare children: state, symbol, pool
        following: list[tuple[int, list[str]]] = []
        for number, members in layer:
            state, by_symbol = states[number], defaultdict(list)
            state.visits = len(members)
            for v in members:
                if len(v) == depth:
                    state.ends += 1
                else:
                    by_symbol[v[depth]].append(v)
            for symbol, own in sorted(by_symbol.items()):
                state.counts[symbol] = len(own)
                if len(own) >= rare:
                    state.to[symbol] = len(states)
                    following.append((len(states), own))
                    states.append(State())
                else:
                    pools[symbol_class(symbol)] += own
                    arrows.append((number, symbol, symbol_class(symbol)))
        numbers = {}
        for name, own in sorted(pools.items()):
            numbers[name] = len(states)
            following.append((len(states), own))
            states.append(State())
        for number, symbol, name in arrows:
            states[number].to[symbol] = numbers[name]
        layer, depth = following, depth + 1
    return states


class Automaton:
    """A probabilistic automaton inferred from values by merging compatible states of their prefix tree."""

    def __init__(self, values: list[str], rare: int = RARE, alpha: float = ALPHA):
        self.states = prefix_tree(values, rare)
        self.same = list(range(len(self.states)))
        self.width = math.sqrt(math.log(2 / alpha) / 2)
        self.merge_all()
        self.log = self.tables()

    def find(self, i: int) -> int:
        while self.same[i] != i:
            self.same[i] = self.same[self.same[i]]
            i = self.same[i]
        return i

    def compatible(self, a: int, b: int) -> bool:
        """Whether ends and symbols of two states, and of all that follows them alike, agree within the bound."""
        seen, stack = set(), [(a, b)]
        while stack:
            a, b = (self.find(x) for x in stack.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            x, y = self.states[a], self.states[b]
            most = self.width * (1 / math.sqrt(x.visits) + 1 / math.sqrt(y.visits))
            if abs(x.ends / x.visits - y.ends / y.visits) > most or any(abs(x.counts[s] / x.visits - y.counts[s] / y.visits) > most for s in x.counts.keys() | y.counts.keys()):
                return False
            stack += [(x.to[s], y.to[s]) for s in x.to.keys() & y.to.keys()]
        return True

    def merge(self, a: int, b: int) -> None:
        """One state of two, and of what follows both by the same symbol."""
        stack = [(a, b)]
        while stack:
            a, b = (self.find(x) for x in stack.pop())
            if a == b:
                continue
            a, b = min(a, b), max(a, b)
            x, y = self.states[a], self.states[b]
            self.same[b] = a
            x.visits, x.ends = x.visits + y.visits, x.ends + y.ends
            x.counts.update(y.counts)
            for symbol, to in y.to.items():
                if symbol in x.to:
                    stack.append((x.to[symbol], to))
                else:
                    x.to[symbol] = to

    def merge_all(self) -> None:
        """States in order of depth: each joins the first settled state that it is compatible with, or is settled itself."""
        settled: list[int] = []
        for i in range(len(self.states)):
            if self.find(i) != i or not self.states[i].visits:
                continue
            settled = [s for s in settled if self.find(s) == s]
            if (match := next((s for s in settled if self.compatible(s, i)), None)) is None:
                settled.append(i)
            else:
                self.merge(match, i)

    def tables(self) -> dict[int, tuple[float, dict[str, tuple[float, int]], float]]:
        """Of each state: log P(end), {symbol: (log P, next)}, log P(any symbol not seen here)."""
        choices, out = len(SYMBOLS) + 1, {}
        for i, state in enumerate(self.states):
            if self.find(i) == i and state.visits:
                log = lambda n, of=state.visits: math.log((n + SMOOTH / choices) / (of + SMOOTH))
                out[i] = (log(state.ends), {s: (log(n), self.find(state.to[s])) for s, n in state.counts.items()}, log(0))
        return out

    def score(self, value: str) -> float:
        """log P(value). What follows a symbol never seen in its state is as likely as any."""
        anything = -math.log(len(SYMBOLS) + 1)
        total, at = 0.0, self.find(0)
        for i, symbol in enumerate(value):
            _, known, other = self.log[at]
            if symbol not in known:
                return total + other + anything * (len(value) - i)
            step, at = known[symbol]
            total += step
        return total + self.log[at][0]


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scorer:
    """Automata of the kinds and of ordinary candidates, and log odds of each kind.

    Candidates hold unlabelled credentials too; those that are one more likely than not leave the ordinary sample, and its automaton is inferred again.
    """

    def __init__(self, samples: dict[int, list[str]], counts: dict[int, int], rounds: int = ROUNDS):
        self.automata = {k: Automaton(v) for k, v in samples.items() if v}
        self.priors = {k: math.log(counts[k] / max(1, counts.get(ORDINARY, 0))) for k in samples if k != ORDINARY and samples[k]}
        rest = samples.get(ORDINARY) or []
        for _ in range(rounds):
            kept = [v for v in rest if self.odds(v)[0] <= 0]
            if not kept or len(kept) == len(rest):
                break
            self.automata[ORDINARY] = Automaton(kept)
            self.priors = {k: p + math.log(len(rest) / len(kept)) for k, p in self.priors.items()}
            rest = kept

    def odds(self, value: str) -> tuple[float, int]:
        """Log odds of the likeliest kind, and minus that kind."""
        ordinary = self.automata[ORDINARY].score(value) if ORDINARY in self.automata else -math.log(len(SYMBOLS) + 1) * (len(value) + 1)
        return max(((self.automata[k].score(value) - ordinary + prior, -k) for k, prior in self.priors.items()), default=(-math.inf, 0))

    def kind(self, value: str, accept: float = ACCEPT) -> int | None:
        """The kind that the value is a credential of, if any."""
        odds, kind = self.odds(value)
        return -kind if odds >= math.log(accept / (1 - accept)) else None


def decide(found: DataFrame, scorer: Scorer, accept: float = ACCEPT) -> DataFrame:
    """Base spans and the candidates whose format is a credential's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for start, kind, end, value in zip(*(batch.column(c).to_pylist() for c in ("start", "kind", "end", "value")), strict=True):
                own = []
                for a, k, b, v in zip(start, kind, end, value, strict=True):
                    k = scorer.kind(v, accept) if k == ORDINARY else k
                    if k is not None:
                        own.append((a, k, b))
                spans.append(spell(sorted(own)))
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(spans, pa.string())], names)

    return found.mapInArrow(run, RESULT)


def fit(found: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Automata from ``sample`` distinct values of each kind, priors from all rows. A few numbers and the samples reach the driver."""
    each = found.select(F.explode(F.arrays_zip("kind", "value")).alias("c")).select("c.kind", "c.value")
    counts = {r["kind"]: r["count"] for r in each.groupBy("kind").count().collect()}
    values = each.filter(F.length("value") <= LONGEST).distinct()
    samples = {}
    for k in range(len(KINDS) + 1):
        rows = values.filter(F.col("kind") == k).select("value", F.xxhash64("value").alias("h")).orderBy("h", "value").limit(sample).collect() if counts.get(k) else []
        samples[k] = [r["value"] for r in rows]
    return Scorer(samples, counts)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: counts and digest of its base spans, and all spans."""
    found = materialize(candidates(docs, id_col, text_col), "secrets")
    return decide(found, fit(found, sample))


def query(spark, sf_dir: str) -> DataFrame:
    """op13 over the whole of ``documents``."""
    return detect(documents(spark, sf_dir))
