"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The base kinds are found by their patterns, leftmost and non-overlapping. The field sees stretches of text around digits,
at-signs, "at" with "dot", and what follows a secret's cue, cut into tokens; a candidate segment is a run of up to ``MOST`` tokens scored as a whole (its digits, groups,
checksums, separators, the cue before it), and dynamic programming chooses boundaries and types together. It adds spans
the patterns can't see, such as phone numbers without a plus, cards in spaced groups of other kinds, addresses written
"name at host dot com", and secrets; it never removes or changes a base span.

The field is trained here, by gradient ascent on the log-likelihood of segmentations, on sentences made from a seed.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded

KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "secret")
MOST = 9

_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a leftmost match can't begin inside a run of digits, so the look-behind changes nothing but the time it takes
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each at-sign: linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _to_255(digits: str) -> bool:
    """Whatever the number of leading zeros."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    if not text or not _ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_to_255, m.group().split(".")))]
    for m in _CARD.finditer(text):
        d = digits_of(m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


# --- the field

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CUES = {"email": 0, "mail": 0, "address": 0, "ip": 1, "server": 1, "addr": 1, "card": 2, "visa": 2, "payment": 2, "phone": 3, "call": 3, "tel": 3, "fax": 3, "mobile": 3, "token": 4, "key": 4, "password": 4, "passwd": 4, "pwd": 4, "passcode": 4, "secret": 4, "api": 4}
_NAMES = (
    "bias", "tokens", "no digit", "digits < 5", "digits 5-6", "digits 7", "digits 8-9", "digits 10-11", "digits 12-15", "digits 14-19 with checksum", "digits 14-19 without",
    "at-sign", "word at word dot", "dots 3", "four parts to 255", "opens +", "has ()", "groups of phone", "groups of four", "letters and digits >= 16", "hex >= 24",
    "quoted", "edge mark", "spaces", "words", "dash", "colon or slash", "cue email", "cue ip", "cue card", "cue phone", "cue secret", "decimal or date", "whole between spaces or quotes", "whole behind a secret's cue",
)
N = len(_NAMES)


def lengths(*groups: bool) -> np.ndarray:
    """Running counts: how many are true before each place."""
    return np.column_stack([np.concatenate([[0], np.cumsum(g)]) for g in groups])


class Segments:
    """Features of whole segments toks[a:b], for many at once, from running counts over the tokens."""

    def __init__(self, text: str, toks: list[tuple[int, int]]):
        self.text, self.toks, n = text, toks, len(toks)
        words = [text[x:y] for x, y in toks]
        low = [w.lower() for w in words]
        flag = lambda test: np.fromiter(map(test, words), bool, n)
        sizes = np.fromiter(map(len, words), np.int64, n)
        self.starts, self.ends = np.array([x for x, _ in toks], np.int64), np.array([y for _, y in toks], np.int64)
        digits = np.fromiter((sum("0" <= c <= "9" for c in w) for w in words), np.int64, n)
        number = digits == sizes
        self.gap = lengths(np.concatenate([[False], self.starts[1:] > self.ends[:-1]]) if n else [])
        self.digits = np.concatenate([[0], np.cumsum(digits)])
        self.letters = np.concatenate([[0], np.cumsum(np.fromiter((sum(c.isalpha() for c in w) for w in words), np.int64, n))])
        is_of = lambda chars: flag(lambda w: w in chars)
        big = np.fromiter((d and (len(w.lstrip("0")) > 3 or int(w[-3:]) > 255) for w, d in zip(words, number.tolist(), strict=True)), bool, n)
        alnum = flag(str.isalnum)
        self.counts = {
            k: np.concatenate([[0], np.cumsum(v)])
            for k, v in {
                "number": number, "big": big, "not 4": number & (sizes != 4), "over 4": number & (sizes > 4), "alpha": flag(str.isalpha), "odd": ~alnum & ~is_of("_-"), "at-sign": is_of("@"), "dots": is_of("."), "(": is_of("("), ")": is_of(")"), "dash": is_of("-"), "colon": is_of(":/"),
                "at": np.fromiter((w == "at" for w in low), bool, n), "dot": np.fromiter((w == "dot" for w in low), bool, n), **{f"cue {c}": np.fromiter((_CUES.get(w, -1) == c for w in low), bool, n) for c in range(5)},
            }.items()
        }
        self.sizes, self.alnum, self.plus, self.opens = sizes, alnum, is_of("+"), is_of("+(")
        self.hex = (sizes >= 24) & (digits > 2) & flag(lambda w: len(w) >= 24 and not w.strip("0123456789abcdefABCDEF"))
        at = np.where(number, np.arange(n), -1)
        self.next_at = np.minimum.accumulate(np.where(np.fromiter((w == "at" for w in low), bool, n), np.arange(n), n)[::-1])[::-1]
        self.last = np.maximum.accumulate(np.concatenate([[-1], at]))  # the last number before a place
        edge = lambda c: c.isspace() or c in "\"'"
        self.left = np.fromiter((x == 0 or edge(text[x - 1]) for x, _ in toks), bool, n)
        self.right = np.fromiter((y == len(text) or edge(text[y]) or (text[y] in ".,;!" and (y + 1 == len(text) or text[y + 1].isspace())) for _, y in toks), bool, n)
        self.quotes = (np.fromiter((x > 0 and text[x - 1] in "\"'" for x, _ in toks), bool, n), np.fromiter((y < len(text) and text[y] in "\"'" for _, y in toks), bool, n))
        self.behind_cue = np.zeros(n, bool)
        for x in secret_places(text, self.starts):
            self.behind_cue[x] = True

    def features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of = lambda k, a=a, b=b: self.counts[k][b] - self.counts[k][a]
        n, letters, numbers, dots = self.digits[b] - self.digits[a], self.letters[b] - self.letters[a], of("number"), of("dots")
        gaps = self.gap[b, 0] - self.gap[np.minimum(a + 1, len(self.gap) - 1), 0]
        size, plain = self.ends[b - 1] - self.starts[a], letters == 0
        f = np.zeros((len(a), N))
        f[:, 0], f[:, 1], f[:, 2] = 1, (b - a) / MOST, n == 0
        for k, (lo, hi) in enumerate(((1, 4), (5, 6), (7, 7), (8, 9), (10, 11), (12, 15))):
            f[:, 3 + k] = (lo <= n) & (n <= hi)
        for i in np.flatnonzero((14 <= n) & (n <= 19) & plain).tolist():
            f[i, 9 if luhn(digits_of(self.text[self.starts[a[i]] : self.ends[b[i] - 1]])) else 10] = 1
        f[:, 11] = of("at-sign") > 0
        f[:, 12] = self._obscured(a, b) & (letters > 4)
        f[:, 13] = (dots == 3) & (numbers == 4)
        f[:, 14] = (f[:, 13] > 0) & (of("big") == 0) & plain
        f[:, 15], f[:, 16] = self.plus[a], (of("(") > 0) & (of(")") > 0)
        last = self.last[b]
        before = self.last[np.maximum(last, 0)]
        some = (numbers >= 2) & (before >= 0)
        x, y = self.sizes[np.maximum(before, 0)], self.sizes[np.maximum(last, 0)]
        f[:, 17] = some & plain & (n >= 7) & (((x == y) & (2 <= x) & (x <= 4)) | ((x == 3) & (y == 4)))
        f[:, 18] = (numbers >= 3) & (of("not 4") - (y != 4) == 0)
        f[:, 19] = (n > 0) & (letters > 0) & (gaps == 0) & (size >= 16) & (of("odd") == 0) & (self.sizes[b - 1] >= 16)
        f[:, 20] = (b - a == 1) & self.hex[a]
        f[:, 21] = self.quotes[0][a] & self.quotes[1][b - 1]
        f[:, 22] = (~self.alnum[a] & ~self.opens[a]) | ~self.alnum[b - 1]
        f[:, 23], f[:, 24] = gaps > 0, of("alpha") > 1
        f[:, 25], f[:, 26] = of("dash") > 0, of("colon") > 0
        for c in range(5):
            f[:, 27 + c] = of(f"cue {c}", np.maximum(a - 4, 0), a) > 0
        f[:, 32] = plain & (((numbers == 2) & (dots == 1)) | ((numbers == 3) & (of("over 4") == 0) & ((n == 6) | (n == 8))))
        whole = self.left[a] & self.right[b - 1] & (gaps == 0)
        f[:, 33], f[:, 34] = whole, whole & self.behind_cue[a]
        return f


    def _obscured(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``name at host dot com`` with or without brackets: a name without gaps, and one word behind the dot."""
        of = lambda k, x, y: self.counts[k][y] - self.counts[k][x]
        n = len(self.sizes)
        at = np.minimum(self.next_at[a], n - 1)
        name_end = np.maximum(np.where(of("(", np.maximum(at - 1, 0), at) > 0, at - 1, at), a)
        solid = self.gap[name_end, 0] - self.gap[np.minimum(a + 1, name_end), 0] == 0
        back = np.maximum(np.where(of(")", np.maximum(b - 2, 0), b - 1) > 0, b - 3, b - 2), 0)
        one = (of("dot", a, b) == 1) & (of("at", a, b) == 1) & (of("dot", back, back + 1) > 0)
        return (b - a >= 5) & one & solid & (a < name_end) & (at + 1 < back) & self.alnum[a] & self.alnum[b - 1]


class Field:
    """weights: one row a type, over a segment's features; a token outside any segment scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def lattice(self, text: str, toks, marks: np.ndarray, after: int = 0):
        """(a, b, scores by type, features) of every candidate segment that ends behind ``after`` tokens: it has a marked token."""
        n = len(toks)
        seen = np.concatenate([[0], np.cumsum(marks)])
        a = np.concatenate([np.arange(max(0, n - k + 1)) for k in range(1, MOST + 1)])
        b = a + np.repeat(np.arange(1, MOST + 1), [max(0, n - k + 1) for k in range(1, MOST + 1)])
        real = (seen[b] > seen[a]) & (b > after)
        a, b = a[real], b[real]
        f = Segments(text, toks).features(a, b) if len(a) else np.zeros((0, N))
        return a, b, f @ self.weights.T, f

    def best(self, text: str, toks, marks: np.ndarray) -> list[tuple[int, int, int]]:
        """The segments (a, b, type) of the best segmentation; the lattice is built block by block, the values are carried on."""
        value, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
        for lo in range(0, len(toks), PIECE):
            hi = min(lo + PIECE, len(toks))
            left = max(0, lo - MOST - 4)  # segments that end in this block, and the cues before them
            a, b, scores, _ = self.lattice(text, toks[left:hi], marks[left:hi], lo - left)
            ends: dict[int, list[tuple[float, int, int]]] = {}
            if len(a):
                kind, top = scores.argmax(1), scores.max(1)
                good = top > 0
                for x, i, j, k in zip(top[good].tolist(), a[good].tolist(), b[good].tolist(), kind[good].tolist(), strict=True):
                    ends.setdefault(j + left, []).append((x, i + left, k))
            for j in range(lo + 1, hi + 1):
                value[j] = value[j - 1]
                for x, i, k in ends.get(j, ()):
                    if value[i] + x > value[j]:
                        value[j], back[j] = value[i] + x, (i, k)
        out, j = [], len(toks)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((i, j, k))
                j = i
        return out[::-1]

    def gradient(self, prepared, gold: list[tuple[int, int]], n: int) -> np.ndarray:
        """Of the log-likelihood: observed less expected features, by the segmental forward and backward sums.

        prepared: (a, b, features) of the candidates; gold: (candidate, type) of the right ones; n: number of tokens.
        """
        a, b, f = prepared
        scores = f @ self.weights.T
        total = np.logaddexp.reduce(scores, axis=1)
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for x, y, v in zip(a.tolist(), b.tolist(), total.tolist(), strict=True):
            ends[y].append((x, v))
            starts[x].append((y, v))
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fwd[j] = log_sum([fwd[j - 1], *(fwd[i] + v for i, v in ends[j])])
        for i in range(n - 1, -1, -1):
            bwd[i] = log_sum([bwd[i + 1], *(bwd[j] + v for j, v in starts[i])])
        p = np.exp(scores + (np.array(fwd)[a] + np.array(bwd)[b] - fwd[n])[:, None])
        grad = -(p.T @ f)
        for i, k in gold:
            grad[k] += f[i]
        return grad


def log_sum(x: list[float]) -> float:
    top = max(x)
    return top if len(x) == 1 else top + math.log(sum(math.exp(v - top) for v in x))


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _examples(n: int, seed: int):
    """(text, [(start, end, type)]): sentences of made-up words with data of each type, and with other numbers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "the", "ou", "ti", "la", "que", "sch", "lo", "mi"]) for _ in range(rng.randrange(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = rng.choice("3456") + num(rng.choice([13, 14, 14, 15, 15, 17]) - 0)
        d += next(x for x in "0123456789" if luhn(d + x))
        return d if rng.random() < 0.5 else rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        return rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)} {num(3)} {num(4)}"])

    def secret():
        kind, mixed = rng.randrange(8), string.ascii_letters + string.digits
        some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 14) + num(2)
        if kind == 1:
            return rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-"]) + num(1) + some(mixed, rng.choice([20, 24, 36]))
        if kind == 2:  # a password: only its cue and marks give it away
            return some(string.ascii_letters, 3) + some("!#%&*-_", rng.randrange(2)) + some(mixed, rng.randrange(3, 8)) + num(1) + some("!#%&*-_", rng.randrange(2)) + some(mixed, 1)
        if kind == 3:
            return num(1) + some(mixed, rng.choice([19, 24, 32, 40]))
        s = some("0123456789abcdef", rng.choice([24, 32, 40, 64, 128]))
        return s if digits_of(s) and s.strip("0123456789") else "a1" + s

    make = {
        0: lambda: rng.choice([f"{word()}.{num(2)}@{word()}{num(1)}.example.com", f"{word()}@{word()}.org", f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}", f"{word()} (at) {word()} (dot) com", f"{word()}@{word()}.co.uk"]),
        1: lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        2: card,
        3: phone,
        4: secret,
    }
    other = [
        lambda: num(rng.randrange(1, 7)), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(2)},{num(3)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}%", lambda: f"{num(1)}.{num(2)}.{num(1)}",
        lambda: f"v{num(1)}", lambda: f"{num(3)} {word()} {num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{num(4)}/{num(2)}", lambda: f"@{word()}", lambda: num(rng.choice([8, 12, 20, 22])), lambda: f"999.{num(3)}.300.{num(2)}", lambda: f"{word()} at {word()} the dot", lambda: f"{num(1)} - {num(2)} - {num(3)}",
    ]
    cues = {0: ["email", "mail"], 1: ["ip", "server"], 2: ["card", "visa"], 3: ["phone", "call", "tel"], 4: ["token =", "key:", "password:", "secret =", "passwd ="]}
    for _ in range(n):
        text, gold = word(), []
        for _ in range(rng.randrange(1, 4)):
            text += " " + " ".join(word() for _ in range(rng.randrange(1, 4))) + rng.choice([" ", " ", ", ", ". "])
            if rng.random() < 0.45:
                text += rng.choice(other)()
            else:
                k = rng.choice([0, 1, 2, 3, 4])
                s = make[k]()
                if rng.random() < (0.3 if k < 4 or len(s) > 18 else 1.0):
                    text += rng.choice(cues[k]) + " "
                mark = '"' if k == 4 and rng.random() < 0.7 else ""
                gold.append((len(text) + len(mark), len(text) + len(mark) + len(s), k))
                text += mark + s + mark
            text += rng.choice([" ", "!! ", "### ", ". ", ", "])
        yield text + word(), gold


def train(examples: int = 900, passes: int = 6, rate: float = 0.15, decay: float = 1e-4, seed: int = 23) -> Field:
    field, rng, data = Field(np.zeros((len(TYPES), N))), np.random.default_rng(seed), []
    field.weights[:, 0] = -2
    for text, gold in _examples(examples, seed):
        toks = tokens_of(text)
        starts, ends = {s: i for i, (s, _) in enumerate(toks)}, {e: i + 1 for i, (_, e) in enumerate(toks)}
        a, b, _, f = field.lattice(text, toks, marked(text, toks))
        place = {x: i for i, x in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
        data.append(((a, b, f), [(place[x], k) for s, e, k in gold if (x := (starts.get(s), ends.get(e))) in place], len(toks)))
    seen = np.full_like(field.weights, 1e-6)
    for _ in range(passes):
        for i in rng.permutation(len(data)):
            g = field.gradient(*data[i]) - decay * field.weights
            seen += g * g
            field.weights += rate * 4 * g / np.sqrt(seen + 1)
    return field


#: Tokens decoded at once.
PIECE = 400
_DIGITS = re.compile(r"[0-9@]+")
_AT, _DOT = re.compile(r"\bat\b", re.I), re.compile(r"\bdot\b", re.I)
_SECRET = re.compile(r"\b(?:password|passwd|pwd|passcode|secret|token|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?", re.I)


def marked(text: str, toks: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that may make a segment: with a digit or at-sign, ``at`` with a ``dot`` soon after it, and what a secret's cue is followed by."""
    out, starts = np.zeros(len(toks), bool), np.array([s for s, _ in toks], np.int64)
    at = np.array([(m.start(), m.end() - 1) for m in _DIGITS.finditer(text)], np.int64).reshape(-1, 2)
    out[np.searchsorted(starts, at.ravel(), "right") - 1] = True
    if _AT.search(text) and _DOT.search(text):
        ats, dots = (np.searchsorted(starts, [m.start() for m in x.finditer(text)], "right") - 1 for x in (_AT, _DOT))
        k = np.searchsorted(dots, ats + 2)
        for a, d in zip(ats[k < len(dots)].tolist(), dots[k[k < len(dots)]].tolist(), strict=True):
            out[[a, d]] |= d - a <= MOST - 3
    out[secret_places(text, starts)] = True
    return out


def secret_places(text: str, starts: np.ndarray) -> list[int]:
    """Tokens, given by where they start, that stand right behind a secret's cue."""
    ends = [m.end() for m in _SECRET.finditer(text, int(starts[0]), int(starts[-1]) + 1)] if len(starts) else []
    at = np.searchsorted(starts, ends)
    return [int(k) for k, e in zip(at, ends, strict=True) if k < len(starts) and starts[k] == e]


def stretches(marks: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of tokens where the field looks: all candidate segments of a marked token and the cues before them, joined if they meet."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(marks).tolist():
        a, b = max(0, i - MOST - 4), min(len(marks), i + MOST)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """(start, end, type) of the field's segments, each stretch decoded as a whole; linear in the text."""
    out, toks = [], tokens_of(text)
    marks = marked(text, toks)
    for lo, hi in stretches(marks):
        near = toks[lo:hi]
        out += [(near[a][0], near[b - 1][1], TYPES[k]) for a, b, k in field.best(text, near, marks[lo:hi])]
    return out


def to_be_looked_at(text: str) -> bool:
    return bool(_ANY.search(text) or _SECRET.search(text) or (_AT.search(text) and _DOT.search(text)))


def all_spans(text: str | None, field: Field):
    """(base spans, all spans); added ones overlap no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    added = field_spans(text, field) if to_be_looked_at(text) else []
    merged, order = list(base), {k: i for i, k in enumerate(TYPES)}
    taken = sorted((s, e) for s, e, _ in base)
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    for s, e, k in added:
        j = bisect.bisect_left(taken, (e, 0))  # base spans that begin before this one ends
        if not j or reach[j - 1] <= s:
            merged.append((s, e, k))
    return base, sorted(merged, key=lambda x: (x[0], order[x[2]]))


def found(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Rows are searched one by one, so repeated rows and null doc_ids are of no concern.
    Of base and added spans with one start the order is that of ``TYPES``. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field or train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
        for batch in bounded(batches, 1):
            both = [all_spans(t, shipped.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows(b) for b, _ in both], kind), pa.array([rows(a) for _, a in both], kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return cols.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def redacted(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with each span of the text replaced by its kind in brackets.

    Of spans that overlap the first stands for the others' beginning, what goes on behind it goes too. Null and empty texts
    stay as they are; repeated rows are changed alike; an empty table stays empty. Other columns don't matter.
    """
    at, shipped = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(field or train())

    def clean(t):
        out, last = [], 0
        for s, e, k in all_spans(t, shipped.value)[1] if t else []:
            if e > last:
                out += [t[last : max(s, last)], f"[{k}]"] if s >= last else []
                last = e
        return t and "".join(out) + t[last:]

    def run(batches):
        for batch in bounded(batches, at):
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document: base counts and their digest; what the field adds in ``n_secret`` (secrets), ``n_added`` (of any kind) and in ``n_spans`` (base and added)."""
    rows = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k, c="base": F.size(F.filter(c, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [*(of(k) for k in KINDS), of("secret", "spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"), F.size("spans").cast("bigint").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def sha_of(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
