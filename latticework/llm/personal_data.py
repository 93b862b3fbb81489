"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

One pass over the whole texts finds base spans (fixed rules that always stay) and candidates: base spans and looser forms
(obfuscated addresses, numbers with other separators, IPv6). Five labelers vote yes, no or abstain on each candidate: the
strict pattern, a validity check, a gazetteer of known prefixes and suffixes, words of the context, and the span's edges.
Votes and coarse shape features make a small code, so the corpus is summed up by counts per (kind, code), a table whose
size the code bounds, not the data. EM on these counts estimates each labeler's reliability per kind and a posterior per
vote pattern; a logistic span classifier is trained on the posteriors over all counts, and spans it accepts are added.

Defined cases: null text is the empty text; very long texts are read whole, in time that grows with their length; of added spans that overlap the one that starts first stays, of
equal starts the first kind; rows that repeat are reported each; null ``doc_id`` stays null; an empty table gives an
empty result; added spans never overlap base spans or each other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, texts, texts_of
from .weak import reliabilities

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "validity", "gazetteer", "context", "edges")
#: Probability from which the classifier adds a span.
ACCEPT = 0.5

# Fixed patterns of the base rules. A run of digits is entered at its first digit alone: where that fails, so do the others, and a match ends where its last run does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms, which are candidates only.
AT = re.compile(r"@|\[at\]|\(at\)")
LOOSE_LOCAL = 64
LOOSE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,8}")
LOOSE = {
    1: re.compile(r"[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    2: re.compile(r"[0-9]{4}(?:[ ./_ -]?[0-9]{4}){2}[ ./_ -]?[0-9]{1,7}"),
    3: re.compile(r"(?:\(?00|\+)?\(?[0-9]{1,4}\)?(?:[ ./ -]\(?[0-9]{2,4}\)?){2,5}"),
}
ANY = re.compile(rb"[0-9@]|[\[(]at[\])]")

# Gazetteers (fixed values).
SUFFIXES = frozenset("com net org edu gov mil int info biz io dev app de fr es uk it nl eu us ca ch at be pt br mx ar au jp cn in ru pl se no dk fi".split())
ISSUERS = ("4", "34", "37", "35", "36", "38", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91")
NEAR = {
    0: ("mail", "contact", "write", "correo", "courriel", "kontakt", "schreib", "escrib", "address"),
    1: ("ip", "host", "server", "address", "login", "from", "adresse"),
    2: ("card", "visa", "master", "credit", "carte", "tarjeta", "karte", "pay"),
    3: ("call", "phone", "tel", "mobile", "fax", "whatsapp", "appel", "llam", "anruf", "handy"),
}
AGAINST = {0: ("import", "class", "def "), 1: ("version", "section", "release", "chapter", "v."), 2: ("order", "isbn", "token", "key", "serial", "hash", "id "), 3: ("isbn", "version", "date", "page", "order", "=")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs: the run of local characters before one, the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def loose(kind: int, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping looser forms. Addresses are found from what stands for their at sign."""
    if kind:
        for m in LOOSE[kind].finditer(text):
            yield m.span()
        return
    last = 0
    for at in AT.finditer(text):
        stop = at.start()
        if stop > last and text[stop - 1] == " ":
            stop -= 1
        start = stop
        while start > max(last, stop - LOOSE_LOCAL) and text[start - 1] in LOCAL:
            start -= 1
        if start < stop and at.start() >= last and (m := LOOSE_DOMAIN.match(text, at.end())):
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(byte(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def votes(kind: int, span: str, before: str, after: str, strict: bool) -> list[int]:
    """Of each labeler: 0 abstains, 1 no, 2 yes."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        suffix = re.split(r"[.\])]", span)[-1].strip().lower()
        valid = 2 if re.fullmatch(r"[a-z]{2,}", suffix) else 1
        known = 2 if suffix in SUFFIXES else 0
    elif kind == 1:
        parts = re.findall(r"[0-9]+", span)
        valid = 2 if ":" in span or len(parts) == 4 and all(byte(p) for p in parts) else 1
        known = 1 if span.startswith(("0.", "127.")) else 2 if span.startswith(("10.", "192.168.", "172.")) else 0
    elif kind == 2:
        valid = 2 if 13 <= len(digits) <= 19 and luhn(digits) else 1
        known = 2 if digits.startswith(ISSUERS) else 1
    else:
        valid = 2 if 9 <= len(digits) <= 15 else 1
        known = 2 if span.startswith(("+", "00", "(00")) and digits.lstrip("0").startswith(CALLING) else 0
    words = before.lower()
    context = 2 if any(w in words for w in NEAR[kind]) else 1 if any(w in words for w in AGAINST[kind]) else 0
    glued = before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("=", "#") or after[:1] in ("%",)
    return [2 if strict else 0, valid, known, context, 1 if glued else 2]


def code(kind: int, span: str, ballot: list[int]) -> int:
    """Votes in base 3, then shape: digits in steps of 3 (up to 7), separators (up to 3)."""
    out = 0
    for v in ballot:
        out = 3 * out + v
    digits = min(7, sum(c.isdigit() for c in span) // 3)
    breaks = min(3, sum(not c.isalnum() for c in span))
    return (out * 8 + digits) * 4 + breaks


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, bool]]]:
    """Base spans, and candidates (start, kind, end, code, base). Spans of one kind never overlap each other, so one look at their ends tells what a looser form meets."""
    base = base_spans(text)
    found = [(a, k, b, True) for a, k, b in base]
    for kind in range(len(KINDS)):
        starts, ends = ([x[i] for x in base if x[1] == kind] for i in (0, 2))
        for a, b in loose(kind, text):
            before = bisect_left(starts, b)  # spans that begin before b
            if not before or ends[before - 1] <= a:
                found.append((a, kind, b, False))
    out = []
    for a, k, b, strict in sorted(found):
        span = text[a:b]
        out.append((a, k, b, code(k, span, votes(k, span, text[max(0, a - 24) : a], text[b : b + 2], strict)), strict))
    return base, out


def join(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and of ``more`` (both sorted) each that meets no base span and none taken before it."""
    starts, furthest, end = [x[0] for x in base], list(accumulate((x[2] for x in base), max)), 0
    out = list(base)
    for a, k, b in more:
        before = bisect_left(starts, b)
        if a >= end and not (before and furthest[before - 1] > a):
            out.append((a, k, b))
            end = b
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, start array<long>, kind array<int>, end array<long>, code array<int>, base array<boolean>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base counts and its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        types = (*[pa.int64()] * 5, pa.string(), *lists)
        names = [x.split()[0] for x in FOUND.split(", ")]
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), [], [], [], [], [])
        for batch in slices(batches, "text"):
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                if not ANY.search(data):
                    out.append((doc, *nothing))
                    continue
                base, more = scan(data.decode("utf-8", "replace"))
                kinds = [k for _, k, _ in base]
                out.append((doc, *(kinds.count(k) for k in range(4)), hashlib.sha256(spell(base).encode()).hexdigest(), *([list(x) for x in zip(*more, strict=True)] or [[]] * 5)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, FOUND)


def ballots(codes: np.ndarray) -> np.ndarray:
    """Votes of each code, one column for each labeler."""
    rest = codes // 32
    return np.stack([rest // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))], axis=1)


def features(codes: np.ndarray) -> np.ndarray:
    """Votes one-hot, digits one-hot, separators one-hot, 1."""
    ballot = ballots(codes)
    columns = [ballot[:, i] == v for i in range(len(LABELERS)) for v in (1, 2)]
    columns += [codes // 4 % 8 == d for d in range(8)] + [codes % 4 == s for s in range(4)] + [np.ones(len(codes), bool)]
    return np.stack(columns, axis=1).astype(float)


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton's method; counts enter as log2(1 + n), so that no pattern drowns the rest."""
    w, n = np.zeros(x.shape[1]), np.log2(1 + n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classifiers(counts: list[tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """The span classifier's weights of each kind from (kind, code, count) rows."""
    out = {}
    for kind in range(len(KINDS)):
        own = [(c, n) for k, c, n in sorted(counts) if k == kind]
        if own:
            codes, n = (np.array(x) for x in zip(*own, strict=True))
            out[kind] = train(features(codes), reliabilities(ballots(codes), n)[2], n)
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def decide(found: DataFrame, weights: dict[int, np.ndarray], accept: float = ACCEPT) -> DataFrame:
    """Base spans and the candidates the classifier accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], bool] = {}

        def accepted(kind: int, number: int) -> bool:
            if (kind, number) not in known:
                known[kind, number] = kind in weights and 1 / (1 + np.exp(-(features(np.array([number])) @ weights[kind])[0])) >= accept
            return known[kind, number]

        for batch in batches:
            spans = []
            for start, kind, end, number, base in zip(*(batch.column(c).to_pylist() for c in ("start", "kind", "end", "code", "base")), strict=True):
                each = list(zip(start, kind, end, number, base, strict=True))
                spans.append(spell(join([(a, k, b) for a, k, b, _, s in each if s], [(a, k, b) for a, k, b, c, s in each if not s and accepted(k, c)])))
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(spans, pa.string())], names)

    return found.mapInArrow(run, RESULT)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of its base spans, and all spans."""
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    each = found.select(F.explode(F.arrays_zip("kind", "code")).alias("c")).groupBy("c.kind", "c.code").count()
    # At most 4 kinds x 3^5 ballots x 32 shapes, whatever the input.
    counts = [(r["kind"], r["code"], r["count"]) for r in each.collect()]
    return decide(found, classifiers(counts))


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over the whole of ``documents``."""
    return detect(documents(spark, sf_dir))
