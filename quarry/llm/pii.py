"""Personal data by a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Runs of tokens that hold digits or at-signs
are then segmented by a semi-Markov CRF: features of a whole candidate span (its shape, counts, checks, neighbours) score it under each
type, spans are of bounded length, and one dynamic programme chooses boundaries and types together. Spans that it finds
and that no base span touches are added; base spans stay. The weights are trained by gradient ascent on the
conditional likelihood of generated lines (``examples``), as no table marks personal data by place; training takes no corpus
rows and a fixed time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "national_id"]
LABELS = ["O", *KINDS]
#: Atoms and characters in a span at most.
MAX_ATOMS, MAX_CHARS = 16, 64
#: Atoms whose scores are made at once, and characters of runs that are decoded together.
PIECE, JOINT = 4096, 1 << 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S++")
_MARKED = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]", re.IGNORECASE)
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at-signs: the part before it runs left to the end of the match before."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
    return found


_DIGIT = re.compile("[0-9]")


def runs(text: str) -> list[tuple[int, int]]:
    """Stretches of neighbouring tokens that hold a digit, an at-sign or a spelt-out one, with one token before an at-sign or after a dot."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out: list[list[int]] = []
    for k, (a, b) in enumerate(tokens):
        m = _MARKED.search(text, a, b)
        if not m:
            continue
        spelt = m.group()[0] in "[({<"
        first = tokens[k - 1][0] if spelt and k else a
        last = tokens[k + 1][1] if spelt and k + 1 < len(tokens) else b
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_CUES = {"card": 0, "visa": 0, "credit": 0, "phone": 1, "tel": 1, "call": 1, "mobile": 1, "fax": 1, "ssn": 2, "social": 2, "ip": 3, "host": 3, "server": 3, "mail": 4, "email": 4, "contact": 4}
_CUE = re.compile("|".join(sorted(_CUES, key=len, reverse=True)), re.IGNORECASE)
N_FEATURES, CONTEXT = 64, 24
#: Shapes of whole spans: feature, pattern.
_SHAPES = {
    47: re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"), 48: re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), 50: re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    49: re.compile(r"[\w.+%-]+ ?[\[({<](?:at|@)[\])}>] ?[\w-]+(?: ?(?:[\[({<](?:dot|\.)[\])}>]|\.) ?[\w-]+)+", re.IGNORECASE),
}
#: Kinds of characters, as bits.
_DIGIT_BIT, _LETTER, _ALNUM, _TEN = 1, 2, 4, 8
_KIND_OF = np.array([_DIGIT_BIT * chr(c).isdigit() | _LETTER * chr(c).isalpha() | _ALNUM * chr(c).isalnum() | _TEN * ("0" <= chr(c) <= "9") for c in range(128)], np.uint8)


def _kinds(codes: np.ndarray) -> np.ndarray:
    out = _KIND_OF[np.minimum(codes, 127)]
    high = np.flatnonzero(codes > 127)
    if len(high):
        seen, back = np.unique(codes[high], return_inverse=True)
        table = [_DIGIT_BIT * c.isdigit() | _LETTER * c.isalpha() | _ALNUM * c.isalnum() for c in map(chr, seen.tolist())]
        out[high] = np.array(table, np.uint8)[back]
    return out


def atoms_of(text: str, a: int, b: int) -> np.ndarray:
    """Starts and ends of the atoms of a run, as rows."""
    return np.array([m.span() for m in _ATOM.finditer(text, a, b)], np.int64).reshape(-1, 2)


def lattice(text: str, atoms: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate segments as (first atom, atoms, features): single atoms, and spans of more whose edges and contents can be personal data.

    upto: of each atom, the number of atoms up to the end of its run; segments don't leave it. Features are indices, padded by N_FEATURES. All
    counts come from sums over characters, so the work is in proportion to the segments.
    """
    low = max(0, int(atoms[0, 0]) - CONTEXT)
    part = text[low : int(atoms[-1, 1]) + 1]
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kind, n = _kinds(codes), len(part)
    begin, end = atoms[:, 0] - low, atoms[:, 1] - low
    size = np.minimum(upto - np.arange(len(atoms)), MAX_ATOMS)
    first = np.repeat(np.arange(len(atoms)), size)
    count = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + 1
    a, b = begin[first], end[first + count - 1]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    tens = sums(kind & _TEN > 0)
    # A mark inside a span ends by b and does not start before a; marks are apart.
    marks = np.array([m.span() for m in _MARKED.finditer(part)], np.int64).reshape(-1, 2)
    inside = np.searchsorted(marks[:, 1], b, "right") > np.searchsorted(marks[:, 0], a, "left")
    padded = np.concatenate([codes, [32]])
    alnum = np.concatenate([kind & _ALNUM > 0, [False]])
    before, after = np.where(a > 0, a - 1, n), np.minimum(b, n)
    opens, last = padded[a], padded[b - 1]
    good_start = alnum[a] | (opens == 43) | (opens == 40)
    edge = good_start & alnum[b - 1] & ~alnum[before] & ~alnum[after]
    keep = (count == 1) | (b - a <= MAX_CHARS) & edge & inside
    first, count, a, b, before, after, opens, last, good_start = (x[keep] for x in (first, count, a, b, before, after, opens, last, good_start))
    of = lambda x: (s := sums(x))[b] - s[a]
    digits, letters, ten = of(kind & _DIGIT_BIT > 0), of(kind & _LETTER > 0), tens[b] - tens[a]
    dots, dashes, ats, spaces, left, right = (of(codes == c) for c in (46, 45, 64, 32, 40, 41))
    # Luhn: sums of the ASCII digits and of their doubles, each over even and odd ranks.
    value = codes[kind & _TEN > 0] - 48
    twice, even = value * 2 - 9 * (value > 4), np.arange(len(value)) % 2 == 0
    s = {(parity, x): sums(np.where(even == parity, (value, twice)[x], 0)) for parity in (True, False) for x in (0, 1)}
    x, y = tens[a], tens[b]
    ends_even = (y - 1) % 2 == 0
    total = np.where(ends_even, s[True, 0][y] - s[True, 0][x] + s[False, 1][y] - s[False, 1][x], s[False, 0][y] - s[False, 0][x] + s[True, 1][y] - s[True, 1][x])
    length = b - a
    feature = np.full((len(first), 26), N_FEATURES, np.int8)
    put = lambda col, where, what: feature.__setitem__((where, col), what[where] if isinstance(what, np.ndarray) else what)
    feature[:, 0] = 0
    feature[:, 1] = np.where(digits > 0, 1 + np.minimum(digits, 19), 21)
    feature[:, 2] = 22 + (letters > 0) + (letters > 3)
    feature[:, 3] = 25 + np.minimum(dots, 4)
    feature[:, 4] = 30 + np.minimum(dashes, 4)
    feature[:, 5] = 35 + np.minimum(ats, 1)
    put(6, opens == 43, 37)
    put(7, opens == 40, 38)
    put(8, (left > 0) & (right > 0), 39)
    put(9, spaces > 0, 40)
    put(10, (ten >= 12) & (ten <= 19) & (total % 10 == 0), 41)
    put(11, ~good_start, 42)
    put(12, ~alnum[b - 1], 43)
    put(13, alnum[before], 44)
    put(14, alnum[after], 45)
    near = np.isin(padded[before], [46, 45, 64, 43, 40]) & (a > 0) | np.isin(padded[after], [45, 64]) & (b < n)
    put(15, near, 46)
    maybe = {47: (ten == 10) & (letters == 0) & (length <= 15), 48: (ten == 9) & (dashes == 2) & (length == 11), 49: (letters >= 3) & (ats + of(np.isin(codes, [91, 40, 123, 60])) > 0), 50: (ats == 1) & (dots > 0)}
    for col, (f, test) in enumerate(maybe.items(), 16):
        for k in np.flatnonzero(test).tolist():
            if _SHAPES[f].fullmatch(part, a[k], b[k]):
                feature[k, col] = f
    for k in np.flatnonzero((dots == 3) & (ten == length - 3) & (ten >= 4) & (ten <= 12)).tolist():
        if all(p and len(p) <= 3 and int(p) <= 255 for p in part[a[k] : b[k]].split(".")):
            feature[k, 20] = 51
    phone = of(np.isin(codes, [32, 40, 41, 46, 45])) + ten + (opens == 43) == length
    put(21, (opens == 43) & phone & (ten >= 2) & alnum[np.minimum(a + 1, n)] & (length > 2), 52)
    feature[:, 22] = 58 + (length > 8) + (length > 14) + (length > 24)
    put(23, count == 1, 62)
    cues = [m.end() for m in _CUE.finditer(part)]
    if cues:
        close = begin - np.concatenate([[-(1 << 40)], cues])[np.searchsorted(cues, begin, "right")] <= CONTEXT
        for k in np.flatnonzero(close).tolist():
            words = re.findall(r"[a-z]+", part[max(0, begin[k] - CONTEXT) : begin[k]].lower())[-2:]
            found = sorted({53 + _CUES[w] for w in words if w in _CUES})
            if found:
                mine = slice(*np.searchsorted(first, [k, k + 1]))
                for col, f in enumerate(found, 24):
                    feature[mine, col] = f
    return first, count, feature


class SemiMarkov:
    """Weights: features x labels, and label pairs. O covers single atoms."""

    def __init__(self) -> None:
        self.w = np.zeros((N_FEATURES + 1, len(LABELS)))  # the last row, of the padding, stays 0
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, first: np.ndarray, count: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Scores by first atom, atoms less one, and label; what is no candidate has -inf."""
        flat = np.zeros((len(first), len(LABELS)))
        for k in range(feature.shape[1]):
            flat += self.w[feature[:, k]]
        flat[count > 1, 0] = -np.inf
        out = np.full((n, MAX_ATOMS, len(LABELS)), -np.inf)
        out[first, count - 1] = flat
        return out

    def decode(self, text: str, runs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """The best segments (first atom, atom after the last, label) of each run of atoms, those of O left out.

        Runs of about the same length go through one dynamic programme side by side; a long run goes by itself, its scores made
        piece by piece, so memory is in proportion to the atoms.
        """
        out: list[list[tuple[int, int, int]]] = [[] for _ in runs]
        by_size: dict[int, list[int]] = {}
        for k, atoms in enumerate(runs):
            if len(atoms):
                by_size.setdefault(int(len(atoms) - 1).bit_length(), []).append(k)
        for bits, mine in by_size.items():
            step = max(1, PIECE >> bits)
            for at in range(0, len(mine), step):
                few = mine[at : at + step]
                for k, found in zip(few, self._decode(text, [runs[k] for k in few]), strict=True):
                    out[k] = found
        return out

    def _decode(self, text: str, runs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        labels, size = len(LABELS), np.array([len(r) for r in runs])
        most, n = int(size.max()), len(runs)
        best = np.full((n, most + 1 + MAX_ATOMS, labels), -np.inf)
        came = np.zeros((n, most + 1 + MAX_ATOMS, labels), np.int32)  # atoms of the segment that ends here
        prev = np.zeros((n, most + 1 + MAX_ATOMS, labels), np.int8)
        best[:, 0, 0] = 0
        wide = np.arange(MAX_ATOMS, dtype=np.int32)[None, :, None] + 1
        scores, base = None, 0
        for i in range(most):
            if scores is None or i >= base + PIECE:
                base, scores = i, self._scores(text, runs, size, i, min(i + PIECE, most))
            through = best[:, i, :, None] + self.t
            before = through.argmax(1).astype(np.int8)
            got = through.max(1)[:, None, :] + scores[:, i - base]
            old = best[:, i + 1 : i + 1 + MAX_ATOMS]
            better = got > old
            old[better] = got[better]
            np.copyto(came[:, i + 1 : i + 1 + MAX_ATOMS], wide, where=better)
            np.copyto(prev[:, i + 1 : i + 1 + MAX_ATOMS], before[:, None, :], where=better)
        out = []
        for k in range(n):
            found, at, y = [], int(size[k]), int(best[k, size[k]].argmax())
            while at > 0:
                i, p = at - int(came[k, at, y]), int(prev[k, at, y])
                if y:
                    found.append((i, at, y))
                at, y = i, p
            out.append(found[::-1])
        return out

    def _scores(self, text: str, runs: list[np.ndarray], size: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Scores of the atoms lo:hi of each run (runs x atoms x MAX_ATOMS x labels)."""
        out = np.full((len(runs), hi - lo, MAX_ATOMS, len(LABELS)), -np.inf)
        near = [(k, r[lo : hi + MAX_ATOMS]) for k, r in enumerate(runs) if len(r) > lo]
        ends = np.concatenate([np.full(len(r), e) for (_, r), e in zip(near, np.cumsum([len(r) for _, r in near]), strict=True)])
        first, count, feature = lattice(text, np.concatenate([r for _, r in near]), ends)
        table = self.scores(first, count, feature, len(ends))
        at = 0
        for k, r in near:
            m = min(len(r), hi - lo)
            out[k, :m] = table[at : at + m]
            at += len(r)
        return out

    def marginals(self, scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, the probability of each segment and label, and the expected number of each pair of labels that follow each other."""
        n, _, labels = scores.shape
        alpha, beta = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        alpha[0, 0], beta[n] = 0, 0
        total = lambda x, axis: (m := np.maximum(x.max(axis), -1e300)) + np.log(np.maximum(np.exp(x - np.expand_dims(m, axis)).sum(axis), 1e-300))
        steps = [min(MAX_ATOMS, n - i) for i in range(n)]
        for i, k in enumerate(steps):
            into = total(alpha[i][:, None] + self.t, 0)
            alpha[i + 1 : i + 1 + k] = np.logaddexp(alpha[i + 1 : i + 1 + k], into[None, :] + scores[i, :k])
        for i in range(n - 1, -1, -1):
            on = total(scores[i, : steps[i]] + beta[i + 1 : i + 1 + steps[i]], 0)
            beta[i] = total(self.t + on[None, :], 1)
        z = float(beta[0, 0])
        p, pairs = np.zeros_like(scores), np.zeros((labels, labels))
        for i, k in enumerate(steps):
            tail = scores[i, :k] + beta[i + 1 : i + 1 + k]
            into = total(alpha[i][:, None] + self.t, 0)
            p[i, :k] = np.exp(np.minimum(into[None, :] + tail - z, 0))
            pairs += np.exp(np.minimum(alpha[i][:, None] + self.t + total(tail, 0)[None, :] - z, 0))
        return z, p, pairs

    def step(self, n: int, segments: tuple[np.ndarray, np.ndarray, np.ndarray], gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the gradient of log p(gold segments | run); all expectations are of the weights before the step."""
        first, count, feature = segments
        _, p, pairs = self.marginals(self.scores(first, count, feature, n))
        change = -p[first, count - 1]
        follow = -pairs
        row = {(i, c): k for k, (i, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True))}
        at, was, starts = 0, 0, {i: (j, y) for (i, j), y in gold.items()}
        while at < n:
            j, y = starts.get(at, (at + 1, 0))
            change[row[at, j - at], y] += 1
            follow[was, y] += 1
            at, was = j, y
        for k in range(feature.shape[1]):
            np.add.at(self.w, feature[:, k], rate * change)
        self.w[N_FEATURES] = 0
        self.t += rate * follow


def examples(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated lines with the places and kinds of what they hold, and lines of other numbers that hold none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return body if r.random() < 0.6 or len(body) != 16 else r.choice(" -").join(body[k : k + 4] for k in range(0, 16, 4))

    makers = {
        "email": [lambda: f"{word()}.{num(2)}@{word()}{r.choice(('', num(1)))}.{r.choice(('com', 'org', 'net', 'example.com'))}", lambda: f"{word()}@{word()}.{word()[:3]}", lambda: f"{word()} {r.choice(('[at]', '(at)', '(AT)'))} {word()} {r.choice(('[dot]', '(dot)'))} com"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [card],
        "phone": [lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}"],
        "national_id": [lambda: f"{num(3)}-{num(2)}-{num(4)}"],
        "O": [lambda: num(r.randint(1, 8)), lambda: f"{num(2)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{num(16)}", lambda: f"{num(3)} {num(3)}", lambda: f"{num(1)},{num(3)}", lambda: f"@{word()}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(5)}-{num(4)}", lambda: "0123456789abcdef"[r.randint(0, 9) :] + num(12) + word()],
    }
    cues = {"email": ["email", "contact"], "ip": ["ip", "host"], "card": ["card", "visa"], "phone": ["phone", "call"], "national_id": ["ssn"], "O": ["page", "call", "card"]}
    out = []
    for _ in range(count):
        line, spans = "", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice(list(makers))
            line += " ".join(word() for _ in range(r.randint(0, 4))) + " " + (r.choice(cues[kind]) + r.choice((" ", ": ")) if r.random() < 0.3 else "")
            value = r.choice(makers[kind])()
            if kind != "O":
                spans.append((len(line), len(line) + len(value), kind))
            line += value + r.choice(("", ".", ",", "!!", "###", "%%%", ")", ";"))
            line += " "
        out.append((line, spans))
    return out


@functools.cache
def trained(count: int = 500, epochs: int = 4) -> SemiMarkov:
    model = SemiMarkov()
    prepared = []
    for line, spans in examples(count):
        for a, b in runs(line):
            atoms = atoms_of(line, a, b)
            if not len(atoms):
                continue
            segments = lattice(line, atoms, np.full(len(atoms), len(atoms)))
            at, end = {s: k for k, (s, _) in enumerate(atoms.tolist())}, {e: k + 1 for k, (_, e) in enumerate(atoms.tolist())}
            gold = {(at[s], end[e]): LABELS.index(kind) for s, e, kind in spans if s in at and e in end}
            known = {(i, i + c) for i, c in zip(segments[0].tolist(), segments[1].tolist(), strict=True)}
            if set(gold) <= known:
                prepared.append((len(atoms), segments, gold))
    for e in range(epochs):
        for n, segments, gold in prepared:
            model.step(n, segments, gold, 0.3 / (1 + e))
    return model


def added_spans(model: SemiMarkov, texts: list[str], taken: list[list[tuple[int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the model finds in each text that touches no base span (``taken``, by text).

    The runs of many texts are copied side by side, with what stands around them, and decoded together; a long run makes a batch by itself.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    parts: list[str] = []
    places: list[tuple[int, int, int, int]] = []  # text, shift, run
    size = 0

    def flush() -> None:
        nonlocal size
        joint = "".join(parts)
        atoms = [atoms_of(joint, a, b) for _, _, a, b in places]
        for (k, shift, _, _), mine, found in zip(places, atoms, model.decode(joint, atoms), strict=True):
            busy = sorted(taken[k])
            starts = [p for p, _ in busy]
            reach = list(itertools.accumulate((q for _, q in busy), max))
            for i, j, y in found:
                s, e = int(mine[i, 0]) - shift, int(mine[j - 1, 1]) - shift
                before = bisect_left(starts, e)  # base spans that start before e: does one of them end behind s?
                if not before or reach[before - 1] <= s:
                    out[k].append((LABELS[y], s, e))
        parts.clear()
        places.clear()
        size = 0

    for k, text in enumerate(texts):
        whole = sorted(taken[k])
        reach = list(itertools.accumulate((q for _, q in whole), max))
        for a, b in runs(text):
            before = bisect_right(whole, (a, len(text) + 1))
            if before and reach[before - 1] >= b:
                continue
            low = max(0, a - CONTEXT)
            piece = "\n" * (low == 0) + text[low : b + 1] + "\n"
            shift = size + (low == 0) - low
            places.append((k, shift, a + shift, b + shift))
            parts.append(piece)
            size += len(piece)
            if size > JOINT:
                flush()
    flush()
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """One row per document: counts of base kinds, base digest, all spans.

    Offsets are code points, ends exclusive. A null text is empty. Repeated rows have one result each; a null id stays null.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    crf = model or trained()
    empty = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1)):
                n = len(texts)
                counts = [[0] * n for _ in BASE]
                digests, every = [empty] * n, [""] * n
                some = [(k, t) for k, t in enumerate(texts.to_pylist()) if t and _MARKED.search(t)]
                bases = []
                for k, t in some:
                    found = base_spans(t)
                    bases.append([(kind, s, e) for kind in BASE for s, e in found[kind]])
                    for c, kind in zip(counts, BASE, strict=True):
                        c[k] = len(found[kind])
                added = added_spans(crf, [t for _, t in some], [[(s, e) for _, s, e in base] for base in bases])
                for (k, _), base, more in zip(some, bases, added, strict=True):
                    digests[k] = hashlib.sha256(joined(base).encode()).hexdigest()
                    every[k] = joined(base + more)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(every)], names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(scan, schema).withColumnRenamed("id", doc_id)
