"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field has labels O and begin/inside of two kinds, secrets (keys, passwords) and
contacts (spelt-out addresses, local telephone numbers). Its features are word shapes,
lengths and a few cue words of a token and its neighbours; it is trained from a small
labelled table by gradient ascent on the exact likelihood. Texts are cut into
sentences, and the sentences of a block are decoded together by Viterbi in numpy.

Pattern spans always stay; a span of the field that overlaps one is left out. A secret that the
field finds is widened to the whole run around it without white space, quotes and delimiters,
so that masking leaves nothing of it.

Defined cases: null and empty texts have no spans; offsets count code points, ends
are exclusive; bytes that are no UTF-8 count as U+FFFD; of labels that score alike the first in order is taken;
rows that repeat are treated alike; very long texts are read whole; an empty labelled table adds no
spans; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import map_rows, release, table
from strobelake.llm.pieces import Memory, distinct_pieces, joined, text_blocks

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("crf_secret", "crf_contact")
KINDS = BASE_KINDS + FIELD_KINDS
BLOCK_BYTES = 2_000_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, leftmost and not overlapping within a kind, by kind and start."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:  # the local part is the run of its characters right before an @ and after the last match
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            out.append(("email", start, low))
        at = text.find("@", max(at + 1, low))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the labelled table -------------------------------------------------------------

#: {s} is a secret and {c} a contact; the rest is not personal data.
_TEMPLATES = [
    'token = "{s:hex40}"', 'token = "{s:hex40}" and more', "token : {s:hex32}", 'api_key = "{s:mixed}"', "api key {s:mixed} for the build", "secret = {s:hex40}",
    "the password is {s:password}", "password : {s:password}", 'set secret_key = "{s:mixed}"', "key = {s:hex32}", "our access key : {s:mixed} do not share", 'with token = "{s:hex40}" as before',
    "write to {c:at}", "mail {c:bracket} today", "contact {c:bracket} or come by", "you may reach me under {c:at} soon",
    "call {c:dashed}", "tel . {c:spaced}", "phone {c:dashed} after noon", "telephone : {c:spaced}", "my number is {c:dashed} now", "fax {c:dashed}",
    "Authorization : Bearer {s:jwt}", "authorization bearer {s:mixed}", 'export API_TOKEN = {s:prefixed}', "my token is {s:prefixed} , keep it", 'password = "{s:password}"', "the secret is {s:password}", "new password {s:password} set",
    "call {c:dotted}", "phone {c:dotted} please", "my number is {c:dotted}", "call us on {c:short}", "tel {c:short}", "telephone {c:short} or write", "reach me at {c:dotted} today", "{w} {w} {w:plain} {w}", "in {w:year} and {w:year}", "from {w:plain} to {w:plain} {w}", "{w:decimal} and {w:decimal} percent",
    "{w} {w} {w:serial} {w} {w}", "the {w:serial} of {w}", "{w} , {w:serial} . {w}", "{w} {w:noise} {w}", "{w:noise} {w:noise}", "{w:echo} {w}", "{w} {w:noise}",
    "we met at noon", "look at the dot on the map", "in 2019 sales rose by 12.5 percent", "version 1.2.3 came out", "pages 100 - 120 of the book", "the token was lost", "a key idea is this",
    "he had no password", "under the terms of version 2.0 of this licence", "the price is 1,299 today", "THE END OF IT !!", "{w:noise}", "{w:noise}", "{w:noise}", "a | b | the | word",
    "El perro de la casa", "Der Hund und das Haus", "Le chien de la maison", "from 9 to 5 each day", "at the end of the day", "room 1204 on floor 12", "it was 10 : 30 then", "she said \" no \" to all",
    "{w:echo}", "born in 1984 , at sea", "call it a day", "the phone rang twice", "a number of them", "my number one song", "secret plans and open talks", "order 48213 is on its way", "{w} {w} {w} {w} .", "{w} , {w} {w} is {w}", "{w} {w} at {w} {w}", "{w} or {w} . {w}", "1 {w} 2 {w} 30 {w}",
    "{w} at at {w}", "{w:echo}", "{w:echo}", "{w} {w} at . {w}", "| at | {w} | at", ", at at {w}", "{w} at {w} at {w}", "at {w} {w} at", "( {w} ) {w} at the", "{w} dot {w} {w}", "is {w} at {w} {w}",
]


def _filler(kind: str, rng: random.Random) -> str:
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rng.randint(1, 4)))
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    digits = "0123456789"
    return {
        "hex40": lambda: some(40, digits + "abcdef"), "hex32": lambda: some(32, digits + "abcdef"), "mixed": lambda: some(rng.randint(20, 40), digits + "ABCDEFGHabcdefgh"),
        "password": lambda: word() + some(rng.randint(2, 4), digits) + word(), "at": lambda: f"{word()} at {word()} dot {rng.choice(('com', 'org', 'net'))}",
        "bracket": lambda: f"{word()} [at] {word()} [dot] {rng.choice(('com', 'org', 'net'))}" if rng.random() < 0.5 else f"{word()} (at) {word()} (dot) {rng.choice(('com', 'org', 'net'))}",
        "dashed": lambda: f"{some(3, digits)}-{some(3, digits)}-{some(4, digits)}", "spaced": lambda: f"0{some(2, digits)} {some(4, digits)} {some(4, digits)}", "w": word,
        "jwt": lambda: ".".join(some(rng.randint(16, 30), digits + "abcdefghijABCDEFGHIJ-_") for _ in range(rng.randint(1, 3))), "prefixed": lambda: f"{some(rng.randint(2, 4), 'abcdefghijk')}_{some(rng.randint(20, 36), digits + 'ABCDEFGHabcdefgh')}",
        "dotted": lambda: f"{some(3, digits)}.{some(3, digits)}.{some(4, digits)}", "short": lambda: f"0{some(rng.randint(2, 3), digits)} {some(rng.randint(6, 7), digits)}",
        "noise": lambda: " ".join(word() + rng.choice(string.punctuation) * rng.randint(1, 4) for _ in range(5)), "echo": lambda: " ".join([rng.choice((word(), *sorted(CUES)))] * 5),
        "serial": lambda: some(rng.randint(9, 19), digits), "plain": lambda: some(rng.randint(1, 5), digits), "year": lambda: f"{rng.choice((18, 19, 20))}{some(2, digits)}", "decimal": lambda: f"{some(rng.randint(1, 3), digits)}.{some(rng.randint(1, 2), digits)}",
    }[kind]()


def labelled_table(copies: int = 3, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): each template filled ``copies`` times."""
    return filled_rows(_TEMPLATES, copies, seed)


def filled_rows(templates: list[str], copies: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng, rows = random.Random(seed), []
    for _ in range(copies):
        for template in templates:
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{(\w)(?::(\w+))?\}", template):
                text += template[at : m.start()]
                filled = _filler(m[2] or m[1], rng)
                if m[1] != "w":
                    spans.append((len(text), len(text) + len(filled), "crf_secret" if m[1] == "s" else "crf_contact"))
                text, at = text + filled, m.end()
            rows.append((text + template[at:], spans))
    return rows


# --- features -----------------------------------------------------------------------

#: Cue words, the word-identity features.
CUES = frozenset(("token", "key", "secret", "password", "api", "access", "call", "phone", "telephone", "tel", "fax", "number", "at", "dot", "mail", "email", "write", "contact", "reach", "com", "org", "net", "is", "my", "bearer", "authorization", "us", "me", "on"))
_HEX = re.compile(rb"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{16,}\Z")


def features(token: bytes) -> tuple[str, ...]:
    """The features of a token by itself."""
    lower = token.lower().decode("utf-8", "replace")
    digits = sum(48 <= b <= 57 for b in token)
    if digits == len(token):
        shape = f"d{min(len(token), 6)}"
    elif digits:
        shape = "mix-long" if len(token) >= 16 else "mix"
    elif len(token) == 1 and not token.isalnum() and token[0] < 128:
        return (f"p{lower}", "punct")
    else:
        shape = "X" if token.isupper() and token.isascii() else "Xx" if token[:1].isupper() else "x"
    size = "l" + next(str(k) for k, n in enumerate((1, 3, 7, 15, 31, 1 << 60)) if len(token) <= n)
    return ("s" + shape, size, "c" + (lower if lower in CUES else "-"), *(("hex",) if _HEX.match(token) else ()))


_SPACE, _WORD, _POINT = 0, 1, 2
_CLASS = np.full(256, _POINT, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether a sentence begins) of the tokens of texts laid end to end: runs of word bytes, and single signs."""
    kind = _CLASS[data]
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _POINT)
    own = bounds[:-1][np.diff(bounds) > 0]
    begin[own] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] != _SPACE
    gap = np.flatnonzero(~word)
    lines = np.add.reduceat(data == 10, starts) > 0 if len(starts) else np.zeros(0, dtype=bool)
    stop = np.zeros(len(starts), dtype=bool)  # a sentence begins after a line end, and after . ! ? and white space
    stop[gap] = lines[gap]
    closing = np.isin(data[starts], (33, 46, 63)) & word
    stop[1:] |= closing[:-1] & ~word[1:]
    first = np.isin(starts, own)
    pending = np.maximum.accumulate(np.where(stop | first, np.arange(len(starts)), -1))
    keep = np.flatnonzero(word)
    before = np.append(-1, keep[:-1])
    return starts[keep], ends[keep], pending[keep] > before if len(keep) else np.zeros(0, dtype=bool)


class Field:
    """The trained field: weights by feature and place (own, before, after), and transitions."""

    labels = ("O", *(f"{b}-{k}" for k in FIELD_KINDS for b in "BI"))
    places = 3

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.rows: dict[tuple[str, ...], int] = {}
        self.table = np.zeros((64, self.places, len(self.labels)), dtype=np.float32)
        self.memory = Memory(lambda ps: {p: self.row(p) for p in ps}, 150_000, 64)

    def row(self, token: bytes) -> int:
        """The row of the score table that holds a token's features."""
        key = features(token)
        at = self.rows.get(key)
        if at is None:
            at = self.rows[key] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for f in key:
                if f in self.names:
                    self.table[at] += self.weights[self.names[f]]
        return at

    def scores(self, row: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Label scores of every token: its own features and its neighbours' within the sentence."""
        out = self.table[row, 0]
        out[1:] += np.where(new[1:, None], 0, self.table[row[:-1], 1])
        out[:-1] += np.where(new[1:, None], 0, self.table[row[1:], 2])
        return out

    def viterbi(self, scores: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The best label of every token; all sentences step together, the long ones last."""
        n, k = scores.shape
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        back = np.zeros((n, k), dtype=np.uint8)
        best = scores[starts].copy()
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if n else 1), side="right")
        moves = self.moves.astype(np.float32)
        for t in range(1, len(alive)):
            m = alive[t]
            at = starts[:m] + t
            step = best[:m, :, None] + moves
            back[at] = step.argmax(axis=1)
            best[:m] = step.max(axis=1) + scores[at]
        out = np.zeros(n, dtype=np.uint8)
        label = best.argmax(axis=1).astype(np.uint8)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at = starts[:m] + t
            out[at] = label[:m]
            if t:
                label[:m] = back[at, label[:m]]
        return out

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """(kind, start byte, end byte) for each text."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in bounds[1:]]
        starts, ends, new = tokens(data, bounds)
        if not len(starts) or not self.names:
            return found
        index, wanted = distinct_pieces(data, starts, ends)
        row = np.array(self.memory.values(wanted), dtype=np.int64)[index]
        label = self.viterbi(self.scores(row, new), new)
        kind = (label + 1) // 2
        opens = (label > 0) & ((label % 2 == 1) | new | (kind != np.append(0, kind[:-1])))
        firsts = np.flatnonzero(opens)
        goes_on = (label > 0) & ~opens
        owner = np.searchsorted(bounds, starts[firsts], side="right") - 1
        for f, o in zip(firsts.tolist(), owner.tolist()):
            last = f
            while last + 1 < len(goes_on) and goes_on[last + 1]:
                last += 1
            found[o].append((FIELD_KINDS[kind[f] - 1], int(starts[f] - bounds[o]), int(ends[last] - bounds[o])))
        return found


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 100, rate: float = 0.2, ridge: float = 0.02) -> Field:
    """Maximise the penalised likelihood of the labelled rows (texts in ASCII) by Adam on exact gradients."""
    k = len(Field.labels)
    names: dict[str, int] = {}
    sentences = []
    for text, spans in rows:
        data, bounds = joined([text.encode()])
        starts, ends, new = tokens(data, bounds)
        label = np.zeros(len(starts), dtype=int)
        for low, high, kind in spans:
            inside = np.flatnonzero((starts >= low) & (ends <= high))
            label[inside] = 2 + 2 * FIELD_KINDS.index(kind)
            label[inside[:1]] -= 1
        own = [[names.setdefault(f, len(names)) for f in features(bytes(data[a:b]))] for a, b in zip(starts, ends)]
        cut = [*np.flatnonzero(new).tolist(), len(starts)]
        sentences += [(own[a:b], label[a:b]) for a, b in zip(cut, cut[1:])]
    if not sentences:
        return Field({}, np.zeros((0, 3, k)), np.zeros((k, k)))
    count, longest = len(sentences), max(len(s[1]) for s in sentences)
    active = np.zeros((count, longest, 3, len(names)))
    truth, mask = np.zeros((count, longest, k)), np.zeros((count, longest), dtype=bool)
    for i, (own, label) in enumerate(sentences):
        for t, fs in enumerate(own):
            mask[i, t] = True
            truth[i, t, label[t]] = 1
            active[i, t, 0, fs] = 1
            if t + 1 < len(own):
                active[i, t + 1, 1, fs] = 1
            if t:
                active[i, t - 1, 2, fs] = 1
    flat = active.reshape(count * longest, -1)
    pairs = np.einsum("ita,itb->ab", truth[:, :-1], truth[:, 1:])
    x = np.zeros(flat.shape[1] * k + k * k)
    m, v = np.zeros_like(x), np.zeros_like(x)
    log_sum = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for step in range(1, steps + 1):
        w, moves = x[: -k * k].reshape(-1, k), x[-k * k :].reshape(k, k)
        s = (flat @ w).reshape(count, longest, k)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None], log_sum(a[:, t - 1, :, None] + moves, 1) + s[:, t], a[:, t - 1])
        total = log_sum(a[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], log_sum(moves + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        single = np.where(mask[..., None], np.exp(a + b - total[:, None, None]), 0)
        both = np.exp(a[:, :-1, :, None] + moves + (s[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
        both = np.where(mask[:, 1:, None, None], both, 0).sum(axis=(0, 1))
        gradient = np.concatenate([(flat.T @ (truth - single).reshape(-1, k)).ravel(), (pairs - both).ravel()]) - ridge * x
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = x[: -k * k].reshape(3, len(names), k).transpose(1, 0, 2)
    return Field(names, weights.astype(np.float32), x[-k * k :].reshape(k, k))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


_SECRET_RUN = re.compile(r"[^\s\"'`=:,;()\[\]{}<>|\\]+")
_TAIL = ".!?"


class Widening:
    """The runs of one text that a secret may fill, cut once; every span is then placed by bisection."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.text = text
        runs = [m.span() for m in _SECRET_RUN.finditer(text)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]
        self.base_starts, self.base_ends = sorted(a for _, a, _ in base), sorted(b for _, _, b in base)
        self.bare: dict[int, int] = {}

    def _without_tail(self, high: int) -> int:
        if high not in self.bare:
            end = high
            while end and self.text[end - 1] in _TAIL:
                end -= 1
            self.bare[high] = end
        return self.bare[high]

    def low(self, a: int) -> int:
        """Where the run begins that reaches up to ``a``, but not before the end of a pattern's span."""
        k = bisect_left(self.starts, a) - 1
        begin = self.starts[k] if k >= 0 and a <= self.ends[k] else a
        j = bisect_right(self.base_ends, a) - 1
        return max(begin, self.base_ends[j]) if j >= 0 else begin

    def high(self, b: int) -> int:
        """Where the run ends that goes on at ``b``, but not after the next pattern's span begins, closing signs left out."""
        k = bisect_right(self.starts, b) - 1
        if k < 0 or b >= self.ends[k]:
            return b
        j = bisect_left(self.base_starts, b)
        end = min(self.ends[k], self.base_starts[j]) if j < len(self.base_starts) else self.ends[k]
        return max(b, self._without_tail(end))


def widened(text: str, spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets with the rest of the run that they lie in, up to the next pattern span and without closing signs; other spans as they are."""
    if not any(kind == "crf_secret" for kind, _, _ in spans):
        return spans
    runs = Widening(text, base)
    return [(kind, runs.low(a), runs.high(b)) if kind == "crf_secret" else (kind, a, b) for kind, a, b in spans]


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap no pattern span."""
    taken = joined_ranges((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    clear = lambda a, b: (k := bisect_left(starts, b) - 1) < 0 or taken[k][1] <= a
    return [s for s in spans if clear(s[1], s[2])]


def joined_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(texts: list[bytes], field: Field) -> Iterator[tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(text, pattern spans, spans the field adds) of each text, in code points."""
    data, bounds = joined(texts)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    for raw, low, more in zip(texts, bounds.tolist(), field.spans(data, bounds)):
        text = raw.decode()
        base = base_spans(text)
        moved = [(kind, int(points[low + a] - points[low]), int(points[low + b] - points[low])) for kind, a, b in more]
        yield text, base, joined_spans(widened(text, apart(moved, base), base))


def joined_spans(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By kind and start; spans of a kind that overlap are one."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])):
        if out and out[-1][0] == kind and a < out[-1][2]:
            out[-1] = (kind, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def _spelt(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the counts and the digest are of the patterns' spans."""
    field = field or default_field()
    parameters = (field.names, field.weights, field.moves)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*parameters)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                counts, digests, spans, added = [], [], [], []
                for _, base, more in all_spans(texts, own):
                    counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                    digests.append(hashlib.sha256(_spelt(base).encode()).hexdigest())
                    spans.append(_spelt(base + more))
                    added.append(len(more))
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *numbers, pa.array(digests), pa.array(spans), pa.array(added, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        release()

    return chosen.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of spans that overlap, their union by the kind of the first."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind.removeprefix('crf_').upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data replaced in text, and n_chars counted anew where there is that column."""
    field = field or default_field()
    parameters = (field.names, field.weights, field.moves)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*parameters)
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            nulls = column.is_null().to_pylist()
            for low, high, texts in text_blocks(column, BLOCK_BYTES):
                clean = [None if null else redact(text, base + more) for null, (text, base, more) in zip(nulls[low:high], all_spans(texts, own))]
                some = batch.slice(low, high - low).columns
                yield pa.RecordBatch.from_arrays([*some[:at], pa.array(clean, pa.string()), *some[at + 1 :]], names=batch.schema.names)
        release()

    clean = map_rows(docs, run)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
