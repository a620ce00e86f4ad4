"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (email, ip, card, phone) are exact and always kept.  Around what
they leave, a semi-Markov CRF scores whole candidate spans: shape, length,
digit count, neighbours, the word before.  Dynamic programming over spans of
at most ``MAX_ATOMS`` atoms chooses boundaries and types together; text
without a digit or an at-sign holds no candidate and costs one scan.

The field is trained here, by maximum likelihood (forward-backward over the
same candidates), on stretches of a bounded sample of documents
(``Training.documents``): the patterns and key assignments label them.  Half
of the phone labels are shown without their leading plus and country code, so
that local forms are learnt from the rest of the span.

Defined results: null counts as the empty text, which has no spans; positions
are code points, end exclusive; rows are treated one by one, so repeated rows
get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_sample, id_text, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_ATOMS = 9
Span = tuple[str, int, int]

# ---------------------------------------------------------------- fixed patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digits before the first dot always start at the head of their run, so the
# lookbehind changes no match and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """At every at-sign the leftmost start is the head of the run of local
    characters before it, cut at the end of the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end if m else 0))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- candidates

_HOOK = re.compile(r"[0-9@]")
_ATOM = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+@-]*[A-Za-z0-9])?|\s+|\S")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,4}$")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
_KEY = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key|key)\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/-]{16,})")
_END = re.compile(r"\s")


def stretches(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words with a digit or an at-sign, cut at taken places.
    Words one space apart belong to one stretch."""
    out: list[list[int]] = []
    pos, hook = 0, _HOOK.search(text)
    while hook:
        start = hook.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        m = _END.search(text, hook.end())
        end = m.start() if m else len(text)
        if out and start - out[-1][1] <= 1:
            out[-1][1] = end
        else:
            out.append([start, end])
        pos = end
        hook = _HOOK.search(text, end)
    if not taken:
        return [tuple(s) for s in out]
    cut, i = [], 0
    taken = sorted(taken)
    for s, e in out:
        while i and taken[i - 1][1] > s:
            i -= 1
        while i < len(taken) and taken[i][0] < e:
            a, b = taken[i]
            if a > s:
                cut.append((s, a))
            s = max(s, b)
            i += 1
        if s < e:
            cut.append((s, e))
    return [(s, e) for s, e in cut if _HOOK.search(text, s, e)]


def _shape(span: str) -> str:
    return _RUNS.sub(lambda m: "d" if m.group()[0].isdigit() else "_" if m.group()[0].isspace() else "a", span)


def _bucket(n: int) -> int:
    return n if n < 8 else 8 + min(12, (n - 8) // 2)


def _features(text: str, atoms: list[tuple[int, int]], i: int, j: int, before: str) -> list[str] | None:
    """Features of the span of atoms i..j-1; None where no span can be."""
    start, end = atoms[i][0], atoms[j - 1][1]
    span = text[start:end]
    if span[0].isspace() or span[-1].isspace() or not (span[-1].isalnum() or span[-1] == ")") or not (span[0].isalnum() or span[0] in "+("):
        return None
    digits = sum(c.isdigit() for c in span)
    if not digits and "@" not in span:
        return None
    shape = _shape(span)
    left, right = text[start - 1:start], text[end:end + 1]
    kind = lambda c: "^" if not c else "_" if c.isspace() else "a" if c.isalpha() else "d" if c.isdigit() else c
    out = ["bias", f"digits{_bucket(digits)}", f"length{_bucket(len(span))}", f"left{kind(left)}", f"right{kind(right)}", f"mix{'a' in shape}{'@' in span}"]
    if 13 <= digits <= 19:
        out.append(f"checksum{luhn(''.join(c for c in span if c.isdecimal()))}")
    out.append(f"shape{shape}" if len(shape) <= 16 else f"runs{_bucket(len(shape))}{set(span) <= set('0123456789abcdefABCDEF')}")
    if i == 0 or before:
        out.append(f"before{before}")
    return out


@dataclass(frozen=True)
class Lattice:
    """Candidate spans of a stretch: for each end, (first atom, features)."""

    atoms: list[tuple[int, int]]
    ending: list[list[tuple[int, list[str]]]]


def lattice(text: str, start: int, end: int) -> Lattice:
    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    ending: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(atoms) + 1)]
    for i in range(len(atoms)):
        m = _WORD_BEFORE.search(text[max(0, atoms[i][0] - 24):atoms[i][0]])
        before = m.group(1).lower() if m else ""
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            f = _features(text, atoms, i, j, before)
            if f:
                ending[j].append((i, f))
    return Lattice(atoms, ending)


# ---------------------------------------------------------------- the field

Weights = dict[str, list[float]]  # feature -> weight per kind


def _scores(w: Weights, features: list[str]) -> list[float]:
    out = [0.0] * len(KINDS)
    for f in features:
        own = w.get(f)
        if own:
            for k, x in enumerate(own):
                out[k] += x
    return out


def decode(w: Weights, lat: Lattice) -> list[Span]:
    """Best segmentation: an atom outside scores 0, a span its features."""
    n = len(lat.atoms)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], None
        for i, f in lat.ending[j]:
            s = _scores(w, f)
            top = max(s)
            if best[i] + top > best[j]:
                best[j], back[j] = best[i] + top, (i, s.index(top))
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((KINDS[k], lat.atoms[i][0], lat.atoms[j - 1][1]))
            j = i
    return out[::-1]


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _gradient(w: Weights, lat: Lattice, gold: set[Span], step: float) -> None:
    """One step up the log-likelihood of the labelled segmentation."""
    n = len(lat.atoms)
    scored = [[(i, f, _scores(w, f)) for i, f in e] for e in lat.ending]
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _logsum([alpha[j - 1]] + [alpha[i] + x for i, _, s in scored[j] for x in s])
    terms: list[list[float]] = [[] for _ in range(n + 1)]
    for j in range(n, 0, -1):
        if j < n:
            beta[j] = _logsum(terms[j])
        terms[j - 1].append(beta[j])
        for i, _, s in scored[j]:
            terms[i] += [beta[j] + x for x in s]
    for j in range(1, n + 1):
        for i, f, s in scored[j]:
            span = (lat.atoms[i][0], lat.atoms[j - 1][1])
            for k, x in enumerate(s):
                p = math.exp(min(0.0, alpha[i] + x + beta[j] - alpha[n]))
                g = ((KINDS[k], *span) in gold) - p
                if abs(g) > 1e-3:
                    for name in f:
                        w.setdefault(name, [0.0] * len(KINDS))[k] += step * g


@dataclass(frozen=True)
class Training:
    """Bounds of the training set and of the fit."""

    documents: int = 4000
    stretches: int = 1500
    stretch_chars: int = 200
    epochs: int = 6
    step: float = 0.2
    decay: float = 1e-3


def labelled(text: str, t: Training) -> list[tuple[str, list[Span]]]:
    """Stretches of a text, each with some context, and their labels."""
    gold = base_spans(text) + [("secret", *m.span(1)) for m in _KEY.finditer(text) if _HOOK.search(m.group(1))]
    gold = [g for n, g in enumerate(gold) if not any(g[1] < o[2] and o[1] < g[2] for o in gold[:n])]
    out = []
    for s, e in stretches(text, []):
        if e - s > t.stretch_chars:
            continue
        own = [g for g in gold if s <= g[1] and g[2] <= e]
        a, b = max(0, s - 24), min(len(text), e + 2)
        out.append((text[a:b], [(k, x - a, y - a) for k, x, y in own]))
        for k, x, y in own:
            m = re.match(r"\+[0-9]{1,3}[ .-]", text[x:y])
            if k == "phone" and m:  # the same number in its local form
                out.append((text[a:x] + text[x + m.end():b], [("phone", x - a, y - a - m.end())]))
    return out


def train(examples: list[tuple[str, list[Span]]], t: Training = Training()) -> Weights:
    w: Weights = {"bias": [-2.0] * len(KINDS)}
    ready = []
    for text, gold in examples:
        for s, e in stretches(text, []):
            ready.append((lattice(text, s, e), set(gold)))
    for epoch in range(t.epochs):
        for lat, gold in ready:
            _gradient(w, lat, gold, t.step / (1 + epoch))
        for own in w.values():
            own[:] = [x * (1 - t.decay) for x in own]
    return w


def fit(docs: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Trains on a bounded sample; the driver gets at most ``t.stretches``
    stretches of at most ``t.stretch_chars`` characters with their context."""

    def cut(batch):
        rows = [(s, [f"{k}:{x}:{y}" for k, x, y in g]) for text in batch.column(1).to_pylist() if text for s, g in labelled(text, t)]
        return {"piece": [r[0] for r in rows], "gold": [r[1] for r in rows]}

    sample = bounded_sample(id_text(docs, id_col, text_col), t.documents, "doc_id", "text")
    pieces = map_batches(sample, cut, "piece string,gold array<string>")
    # both kinds of stretches, with and without a label, are needed: half each
    ordered = [pieces.filter(F.size("gold") > 0 if some else F.size("gold") == 0).orderBy(F.xxhash64("piece"), "piece").limit(t.stretches // 2).collect()
               for some in (True, False)]
    examples = [(r.piece, [(k, int(x), int(y)) for k, x, y in (g.split(":") for g in r.gold)]) for r in turns(ordered)]
    return train(examples, t)


def turns(lists: list[list]) -> list:
    """Takes turns, so that no epoch ends on one kind of example."""
    return [x[i] for i in range(max(map(len, lists), default=0)) for x in lists if i < len(x)]


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans)."""
    base = base_spans(text)
    added = [s for a, b in stretches(text, [(x, y) for _, x, y in base]) for s in decode(w, lattice(text, a, b))]
    return base, added


def _join(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1])))


def find_pii(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind over all spans' base kinds, the
    base spans and all spans as ``kind:start:end`` lists."""
    w = fit(docs, id_col=id_col, text_col=text_col) if weights is None else weights

    def find(batch):
        out = defaultdict(list)
        for text in batch.column(1).to_pylist():
            base, added = all_spans(text or "", w)
            for k in BASE_KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base"].append(_join(base))
            out["base_sha256"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
            out["spans"].append(_join(base + added))
            out["n_added"].append(len(added))
        return {"doc_id": batch.column(0), **out}

    return map_batches(id_text(docs, id_col, text_col), find,
                       "doc_id bigint,n_email bigint,n_ip bigint,n_card bigint,n_phone bigint,base string,base_sha256 string,spans string,n_added bigint")


def redacted(text: str | None, w: Weights) -> str | None:
    """Every span, overlapping ones together, gives way to its kind's mark."""
    if not text:
        return text
    base, added = all_spans(text, w)
    out, pos, until = [], 0, -1
    for k, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s >= until:
            out += [text[pos:s], f"[{k.upper()}]"]
        until = max(until, e)
        pos = until
    return "".join(out) + text[pos:]


def redact(text: Column, w: Weights) -> Column:
    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: redacted(t, w))

    return run(text)
