"""Personal data in text: fixed patterns, and a character model for the rest.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their
usual spelling; what they find always stays. A bidirectional LSTM over characters
with CRF transitions on top adds spans in spellings they miss, such as
"name (at) host (dot) com" or digits set apart by other marks.

The model is trained in numpy on the driver, from spans that the patterns label in
a bounded sample of snippets (``SNIPPETS`` of ``SNIPPET_CHARS``) and from respelled
copies of such spans set into the same snippets. It reads the neighbourhood of
every place where personal data could be: each digit or ``@``, each "at" or "dot"
in brackets, each "dot" as a word, and each word "at" before something with a dot.
A neighbourhood ends between words; those that touch become one region. A region
is read in overlapping windows, whose scores are averaged with weights that fall
towards their ends, and one Viterbi pass decodes the whole region, however long: it
goes on from stretch to stretch, and what all its survivors agree on is decided and
let go. A decoded span counts if its mean probability, within ``CONTEXT`` characters
around it, is high and it has what its kind needs (enough digits, an "at"; none is
longer than ``LONGEST``). An address gives up words at its ends that do not belong
to it by the way addresses are spelled out.

Defined cases: a null text is empty and has no spans; equal spans of different
kinds are all reported; rows are independent of each other, and repeated ones
give repeated results; without a snippet to learn from, only made-up ones are.
An empty table gives no rows. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.workers import ship_package

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, end, kind

# ---- fixed patterns -------------------------------------------------------

_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails fails from each of its digits: possessive, from its first
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost, not
    overlapping, in one pass: a match begins where the run before an @ does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        found = _AFTER_AT.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and then kind."""
    if not _MAYBE.search(text):
        return []
    spans: list[Span] = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            spans.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=_order)


def _order(span: Span):
    return span[0], KINDS.index(span[2]), span[1]


# ---- the network ----------------------------------------------------------

# outside, and for each kind its first and its further characters
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_TAGS = len(TAGS)
HIDDEN, EMBED, WINDOW, STRIDE, MARGIN = 20, 12, 72, 36, 24
EPOCHS, RATE, BATCH = 24, 0.02, 32
SNIPPETS, SNIPPET_CHARS = 400, WINDOW
LEAST_PROBABILITY = 0.9
LONGEST, CONTEXT = 1000, 2 * WINDOW  # characters of a span, and on both sides of it
N_CODES = 128 + 4


def encode(text: str) -> np.ndarray:
    """A small code for each character: ASCII, other letters, digits, spaces, rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    for i in np.flatnonzero(codes >= 128):
        c = chr(codes[i])
        codes[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return codes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Direction:
    """One LSTM over sequences laid side by side, (time, batch, features)."""

    @staticmethod
    def start(rng, d: int, h: int) -> dict[str, np.ndarray]:
        w = rng.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h))
        b = np.zeros(4 * h)
        b[h : 2 * h] = 1  # remember at first
        return {"w": w.astype(np.float32), "b": b.astype(np.float32)}

    @staticmethod
    def forward(p, x):
        t, n, d = x.shape
        h = p["b"].size // 4
        inputs = x @ p["w"][:d] + p["b"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, cells, gates = (np.empty((t, n, k), np.float32) for k in (h, h, 4 * h))
        recurrent = p["w"][d:]
        for i in range(t):
            z = inputs[i] + state @ recurrent
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            state = z[:, 2 * h : 3 * h] * np.tanh(cell)
            states[i], cells[i], gates[i] = state, cell, z
        return states, cells, gates

    @staticmethod
    def backward(p, x, states, cells, gates, grad):
        t, n, d = x.shape
        h = p["b"].size // 4
        gw, gx = np.zeros_like(p["w"]), np.empty_like(x)
        gb = np.zeros_like(p["b"])
        g_state, g_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i in range(t - 1, -1, -1):
            g_in, g_forget, g_out, g_new = (gates[i][:, k * h : (k + 1) * h] for k in range(4))
            g = grad[i] + g_state
            tc = np.tanh(cells[i])
            g_cell = g_cell + g * g_out * (1 - tc * tc)
            before = cells[i - 1] if i else np.zeros_like(g_cell)
            dz = np.concatenate((
                g_cell * g_new * g_in * (1 - g_in), g_cell * before * g_forget * (1 - g_forget),
                g * tc * g_out * (1 - g_out), g_cell * g_in * (1 - g_new * g_new)), axis=1)
            g_cell = g_cell * g_forget
            last = states[i - 1] if i else np.zeros((n, h), np.float32)
            gw += np.concatenate((x[i], last), axis=1).T @ dz
            gb += dz.sum(axis=0)
            back = dz @ p["w"].T
            gx[i], g_state = back[:, :d], back[:, d:]
        return {"w": gw, "b": gb}, gx


def _allowed() -> np.ndarray:
    """Transitions: a further character only follows one of its kind."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


_ALLOWED = _allowed()
_START = np.array([not t.startswith("I-") for t in TAGS])
_NEVER = -1e4


@dataclass
class Tagger:
    params: dict[str, dict[str, np.ndarray]]

    @classmethod
    def new(cls, rng) -> Tagger:
        out = rng.normal(0, 0.3, (2 * HIDDEN, N_TAGS)).astype(np.float32)
        # characters of one class start close to each other
        ascii_class = np.array([
            0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isspace()
            else 4 + i for i, c in enumerate(map(chr, range(128)))])
        classes = np.concatenate((ascii_class, 200 + np.arange(N_CODES - 128)))
        embed = rng.normal(0, 1.0, (256, EMBED))[classes] + rng.normal(0, 0.1, (N_CODES, EMBED))
        return cls({
            "embed": {"e": embed.astype(np.float32)},
            "ahead": Direction.start(rng, EMBED, HIDDEN), "back": Direction.start(rng, EMBED, HIDDEN),
            "top": {"w": out, "b": np.zeros(N_TAGS, np.float32),
                    "t": np.zeros((N_TAGS, N_TAGS), np.float32)},
        })

    def scores(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, batch, tags) of codes (time, batch)."""
        p = self.params
        x = p["embed"]["e"][codes]
        ahead = Direction.forward(p["ahead"], x)
        back = Direction.forward(p["back"], x[::-1])
        both = np.concatenate((ahead[0], back[0][::-1]), axis=2)
        return both @ p["top"]["w"] + p["top"]["b"], (codes, x, ahead, back, both)

    def transitions(self) -> np.ndarray:
        return np.where(_ALLOWED, self.params["top"]["t"], _NEVER)

    def gradient(self, codes: np.ndarray, tags: np.ndarray):
        """Of the mean log-likelihood per character, by parameter."""
        p = self.params
        scores, (codes, x, ahead, back, both) = self.scores(codes)
        found, pairs = crf_marginals(scores, self.transitions())
        t, n, _ = scores.shape
        error = -found.astype(np.float32)
        np.put_along_axis(error, tags[:, :, None], np.take_along_axis(error, tags[:, :, None], 2) + 1, 2)
        error /= t * n
        gold = np.zeros((N_TAGS, N_TAGS))
        np.add.at(gold, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        g_top = {"w": np.tensordot(both, error, ((0, 1), (0, 1))), "b": error.sum(axis=(0, 1)),
                 "t": np.where(_ALLOWED, (gold - pairs) / (t * n), 0).astype(np.float32)}
        down = error @ p["top"]["w"].T
        g_ahead, gx = Direction.backward(p["ahead"], x, *ahead, down[:, :, :HIDDEN])
        g_back, gx_back = Direction.backward(p["back"], x[::-1], *back, down[::-1, :, HIDDEN:])
        g_embed = np.zeros_like(p["embed"]["e"])
        np.add.at(g_embed, codes.ravel(), (gx + gx_back[::-1]).reshape(-1, EMBED))
        return {"embed": {"e": g_embed}, "ahead": g_ahead, "back": g_back, "top": g_top}


def crf_marginals(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities, and expected transitions summed over time and batch."""
    t, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    m = np.exp(trans)
    alpha, beta = np.empty((t, n, k)), np.ones((t, n, k))
    alpha[0] = e[0] * _START
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        alpha[i] = (alpha[i - 1] @ m) * e[i]
        alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = e[i + 1] * beta[i + 1]
        z = np.einsum("na,ab,nb->n", alpha[i], m, ahead)
        pairs += np.einsum("na,ab,nb->ab", alpha[i] / z[:, None], m, ahead)
        beta[i] = ahead @ m.T
        beta[i] /= beta[i].sum(axis=1, keepdims=True)
    found = alpha * beta
    return found / found.sum(axis=2, keepdims=True), pairs


# ---- training -------------------------------------------------------------


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for start, end, kind in spans:
        if not tags[start:end].any():  # of overlapping ones, the first
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return tags


def _made_up(rng, kind: str) -> str:
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(a, b))))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *c: c[int(rng.integers(len(c)))]
    if kind == "email":
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"),
                       ("@", "."), (" @ ", " . "), (" at ", " dot "), ("{at}", "{dot}"), (" at ", "."), (" at ", "."))
        case = pick(str, str, str.upper, str.title)
        at, dot = case(at), case(dot)
        name = word(2, 9) + pick("", "." + word(2, 7), number(2), "." + number(2), "." + word(4, 9) + "-" + word(4, 7))
        place = word(3, 9) + pick("", number(1), "-" + word(4, 9))
        return name + at + place + dot + pick("com", "org", "net", "example" + dot + "com")
    if kind == "ip":
        sep = pick(".", ".", "[.]", "(.)", " . ")
        return sep.join(str(v) for v in rng.integers(0, 256, 4))
    if kind == "card":
        digits = number(int(rng.choice([15, 16, 16, 16]) - 1))
        digits += next(d for d in "0123456789" if luhn(digits + d))
        sep = pick("", " ", "-", ".", "/", "_")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    sep = pick(" ", "-", ".", "/")
    country = str(int(rng.integers(1, 99)))
    area = number(3)
    if rng.integers(4) == 0:  # without a country code
        return pick(f"({area}) ", area + sep) + number(3) + pick("-", sep) + number(4)
    return pick("+", "+", "00") + country + pick(f" ({area}) ", sep + area + sep) + number(3) + sep + number(4)


def training_set(snippets: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags, (examples, WINDOW): the snippets as the patterns label them,
    and with made-up spans set in; numbers that are nothing of the kind too."""
    rng = np.random.default_rng(seed)
    plain = [s for s in snippets if s] or ["text without any names or numbers in it at all " * 3]
    examples: list[tuple[str, list[Span], tuple[int, int]]] = [(s, base_spans(s), (len(s), 0)) for s in plain]
    fillers = [s for s in plain if not base_spans(s)] or plain
    for i in range(3 * SNIPPETS):
        around = fillers[int(rng.integers(len(fillers)))]
        around = around + " " + fillers[int(rng.integers(len(fillers)))]
        cut = around.find(" ", int(rng.integers(0, WINDOW // 2))) + 1
        if i % 4 == 3:  # other numbers: years, versions, hexadecimal words, amounts
            what = [str(rng.integers(1, 10 ** int(rng.integers(1, 9)))),
                    f"{rng.integers(0, 30)}.{rng.integers(0, 30)}",
                    f"{rng.integers(0, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}",
                    '"' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"',
                    "at " + str(rng.integers(1, 99)), f"{rng.integers(1, 999)},{rng.integers(100, 999)}"][
                int(rng.integers(6))]
            spans: list[Span] = []
        else:
            kind = KINDS[int(rng.integers(4))]
            what = _made_up(rng, kind)
            spans = [(cut, cut + len(what), kind)]
        end = ["", ".", ",", "!!", "***"][int(rng.integers(5))] + " "
        text = around[:cut] + what + end + around[cut:]
        spans += [(a + cut + len(what) + len(end), b + cut + len(what) + len(end), k)
                  for a, b, k in base_spans(around[cut:])]
        spans += base_spans(around[:cut])
        examples.append((text, sorted(spans), (cut, cut + len(what))))
    codes, tags = [], []
    for text, spans, (start, end) in examples:
        text_codes, text_tags = encode(text), tags_of(len(text), spans)
        most = max(0, len(text) - WINDOW)
        # what was set in stays whole
        high = min(most, start)
        shift = int(rng.integers(min(high, max(0, end - WINDOW)), high + 1))
        c, t = text_codes[shift : shift + WINDOW], text_tags[shift : shift + WINDOW].copy()
        if len(t) and t[0] and t[0] % 2 == 0:
            t[: int(np.argmax(t != t[0])) or len(t)] = 0  # a span cut at its front
        pad = WINDOW - len(c)
        codes.append(np.pad(c, (0, pad), constant_values=32))
        tags.append(np.pad(t, (0, pad)))
    return np.stack(codes), np.stack(tags)


def train(snippets: list[str], seed: int = 5) -> Tagger:
    codes, tags = training_set(snippets, seed)
    rng = np.random.default_rng(seed)
    tagger = Tagger.new(rng)
    first = {n: {k: np.zeros_like(v) for k, v in p.items()} for n, p in tagger.params.items()}
    second = {n: {k: np.zeros_like(v) for k, v in p.items()} for n, p in tagger.params.items()}
    step, last = 0, EPOCHS * -(-len(codes) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            grads = tagger.gradient(codes[some].T, tags[some].T)
            step += 1
            rate = RATE * (1 - 0.9 * step / last)
            for name, part in grads.items():
                for key, g in part.items():
                    m, v = first[name][key], second[name][key]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    tagger.params[name][key] += rate * (m / (1 - 0.9**step)) / (
                        np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


# ---- reading whole texts --------------------------------------------------

_PLACE = re.compile(
    r"[0-9@]++|[(\[{<]\s?(?:at|dot|\.)\s?[)\]}>]|(?<=\s)(?:dot|\.)(?=\s)"
    r"|(?<=\s)at(?=\s+[^\s.]+(?:\.\w|\s*[(\[{<]?\s*dot\b|\s+\.\s))", re.I)
_SPACE = re.compile(r"\s")
_AT = re.compile(r"@|[(\[{ ]\s?at\s?[)\]} ]", re.I)


def regions(text: str) -> list[tuple[int, int]]:
    """The neighbourhoods of all places where personal data could be, grown to whole
    words and merged."""
    found: list[list[int]] = []
    for m in _PLACE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if found and b <= found[-1][1]:
            continue
        least = found[-1][1] if found else 0
        while a > least and not text[a - 1].isspace():
            a -= 1
        end = _SPACE.search(text, b)
        b = end.start() if end else len(text)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def _windows(start: int, end: int) -> list[int]:
    last = max(start, end - WINDOW)
    return [*range(start, last, STRIDE), last]


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
READ_AT_ONCE = 512


class Decoder:
    """One Viterbi pass over a region that comes in stretches. Arrays begin at
    ``first``; places below ``first + len(tags)`` are decided."""

    def __init__(self, trans: np.ndarray):
        self.trans, self.first = trans, 0
        self.sums = np.zeros((0, N_TAGS + 1))  # weighed scores and weights, still growing
        self.mean = np.zeros((0, N_TAGS))
        self.back = np.zeros((0, N_TAGS), np.int8)
        self.tags = np.zeros(0, np.int64)
        self.best: np.ndarray | None = None
        self.told = 0  # spans that start before were handed out

    def feed(self, starts: list[int], scores: np.ndarray, done: int, last: bool) -> Iterator[tuple]:
        """Windows in order; ``done`` is the place from which more may come. The
        spans that are certain now: start, end, number of the kind, probability."""
        at = self.first + len(self.mean)
        end = max([at + len(self.sums), *(min(s + WINDOW, done) if last else s + WINDOW for s in starts)])
        self.sums = np.pad(self.sums, ((0, end - at - len(self.sums)), (0, 0)))
        for start, window in zip(starts, scores):
            n = min(WINDOW, end - start)
            self.sums[start - at : start - at + n, :N_TAGS] += window[:n] * _WEIGHT[:n, None]
            self.sums[start - at : start - at + n, N_TAGS] += _WEIGHT[:n]
        ready, self.sums = self.sums[: done - at], self.sums[done - at :]
        self._step(ready[:, :N_TAGS] / ready[:, N_TAGS:])
        self._decide(last)
        yield from self._closed(done, last)

    def _step(self, mean: np.ndarray) -> None:
        back = np.zeros((len(mean), N_TAGS), np.int8)
        for i, score in enumerate(mean):
            if self.best is None:
                self.best = np.where(_START, score, _NEVER)
                continue
            total = self.best[:, None] + self.trans
            back[i] = total.argmax(axis=0)
            self.best = total.max(axis=0) + score
        if self.best is not None:
            self.best = self.best - self.best.max()
        self.mean, self.back = np.concatenate((self.mean, mean)), np.concatenate((self.back, back))

    def _decide(self, last: bool) -> None:
        known, n = len(self.tags), len(self.mean)
        if known == n:
            return
        paths = np.array([self.best.argmax()]) if last else np.arange(N_TAGS)
        i = n - 1
        while len(paths) > 1 and i > known:  # back to where all survivors agree
            paths = np.unique(self.back[i][paths])
            i -= 1
        if len(paths) > 1:
            return
        tags = [int(paths[0])]
        for j in range(i, known, -1):
            tags.append(int(self.back[j][tags[-1]]))
        self.tags = np.concatenate((self.tags, tags[::-1])).astype(np.int64)

    def _closed(self, done: int, last: bool) -> Iterator[tuple]:
        tags, keep = self.tags, self.first + len(self.tags)
        for j in np.flatnonzero(tags % 2 == 1):
            start = self.first + int(j)
            if start < self.told:
                continue
            others = np.flatnonzero(tags[j + 1 :] != tags[j] + 1)
            end = start + 1 + int(others[0]) if len(others) else self.first + len(tags)
            if not last and end - start <= LONGEST and (not len(others) or end + CONTEXT > done):
                keep = start
                break
            self.told = start + 1
            if end - start <= LONGEST:
                a, b = max(0, int(j) - CONTEXT), end - self.first + CONTEXT
                sure, _ = crf_marginals(self.mean[a:b, None, :], self.trans)
                places = np.arange(start, end) - self.first
                yield start, end, (int(tags[j]) - 1) // 2, float(sure[places - a, 0, tags[places]].mean())
        drop = min(keep, self.first + len(self.tags)) - CONTEXT - self.first
        if drop > 0:
            self.first += drop
            self.mean, self.back, self.tags = self.mean[drop:], self.back[drop:], self.tags[drop:]


class Reader:
    """Spans of the model in whole texts; windows of many texts are read together."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.trans = tagger.transitions().astype(np.float64)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        found: list[list[Span]] = [[] for _ in texts]
        pieces, size = [], 0
        for i, text in enumerate(texts):
            for a, b in regions(text):
                decoder, starts = Decoder(self.trans), _windows(0, b - a)
                for at in range(0, len(starts), READ_AT_ONCE):
                    some = starts[at : at + READ_AT_ONCE]
                    last = at + READ_AT_ONCE >= len(starts)
                    done = b - a if last else starts[at + READ_AT_ONCE]
                    pieces.append((i, a, b, decoder, some, done, last))
                    size += len(some)
                    if size >= READ_AT_ONCE:
                        self._read(pieces, texts, found)
                        pieces, size = [], 0
        self._read(pieces, texts, found)
        return found

    def _read(self, pieces: list[tuple], texts: list[str], found: list[list[Span]]) -> None:
        if not pieces:
            return
        windows = []
        for i, a, b, _, starts, _, _ in pieces:
            codes = encode(texts[i][a + starts[0] : min(b, a + starts[-1] + WINDOW)])
            for w in starts:
                part = codes[w - starts[0] : w - starts[0] + WINDOW]
                windows.append(np.pad(part, (0, WINDOW - len(part)), constant_values=32))
        scores = np.concatenate([
            self.tagger.scores(np.stack(windows[at : at + READ_AT_ONCE]).T)[0].transpose(1, 0, 2)
            for at in range(0, len(windows), READ_AT_ONCE)]).astype(np.float64)
        at = 0
        for i, a, _, decoder, starts, done, last in pieces:
            part = scores[at : at + len(starts)]
            at += len(starts)
            for start, end, kind, sure in decoder.feed(starts, part, done, last):
                if sure >= LEAST_PROBABILITY:
                    span = trimmed(texts[i], a + start, a + end, KINDS[kind])
                    if plausible(texts[i][span[0] : span[1]], span[2]):
                        found[i].append(span)


_SPELLED = re.compile(
    r"[\w.%+-]+(?:@|\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s+(?:at|@)\s+)[\w-]+"
    r"(?:(?:\.|\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\s+(?:dot|\.)\s+)[\w-]+)+", re.I)


def trimmed(text: str, start: int, end: int, kind: str) -> Span:
    """The span, of an address only what is spelled as one."""
    if kind == "email":
        # whole words
        while start > 0 and end - start < LONGEST and not text[start - 1].isspace() and text[start].isalnum():
            start -= 1
        found = _SPELLED.search(text, start, min(len(text), end + WINDOW))
        if found and found.start() < end:
            return found.start(), found.end(), kind
    return start, end, kind


def plausible(span: str, kind: str) -> bool:
    """What a span of the kind must have, however it is spelled."""
    digits = _digits(span)
    if span != span.strip() or "\n" in span or len(span) > LONGEST:
        return False
    if kind == "email":
        return bool(_AT.search(span)) and bool(re.search(r"\.|dot", span, re.I)) and len(span) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", span)
    # without a prefix, what sets the digits apart tells a phone from a number
    known = span[:1] in "+0(" or len(re.findall("[0-9]{2,}", span)) >= 3
    return 9 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", span) and known and len(span) <= 30


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """The base spans and the added ones that overlap none of them."""
    free = [s for s in added if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
    return sorted({*base, *free}, key=_order)


def spell(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ---- on Spark -------------------------------------------------------------


def snippets(docs: DataFrame, n: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> list[str]:
    """Bounded pieces of text around a first digit or @, those with the smallest
    hashes; equal pieces count once."""
    around = F.regexp_extract("text", rf"(?s)[^0-9@]{{0,{chars // 2}}}[0-9@].{{0,{chars - chars // 2 - 1}}}", 0)
    found = docs.where(F.col("text").rlike("[0-9@]")).select(around.alias("s")).where("s != ''")
    rows = found.groupBy("s").agg(F.min(F.xxhash64("s")).alias("h")).orderBy("h", "s").limit(n).collect()
    return sorted(r["s"] for r in rows)


FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    reader = Reader(tagger)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            some = [t or "" for t in texts.slice(at, 256).to_pylist()]
            base = [base_spans(t) for t in some]
            spans = [all_spans(b, a) for b, a in zip(base, reader.spans(some))]
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(some)), *counts,
                 pa.array([hashlib.sha256(spell(b).encode()).hexdigest() for b in base]),
                 pa.array(map(spell, spans), pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and hash of the base spans, and all ``spans``, per row."""
    ship_package(docs.sparkSession)
    tagger = train(snippets(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _find(b, tagger), "doc_id long, " + FOUND)


def _masked(text: str, spans: list[Span]) -> str:
    """``text`` with spans replaced by their kinds; of overlapping ones, one mark
    for all, of the first kind."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start < at:
            at = max(at, end)
            continue
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    reader = Reader(tagger)
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("text")).to_pylist()
        masked: list = []
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            added = reader.spans([t or "" for t in some])
            masked += [None if t is None else _masked(t, all_spans(base_spans(t), a))
                       for t, a in zip(some, added)]
        columns = list(batch.columns)
        columns[names.index("text")] = pa.array(masked, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked, and ``n_chars``, if it is a
    column, counted anew."""
    ship_package(docs.sparkSession)
    tagger = train(snippets(docs))
    masked = docs.mapInArrow(lambda b: _mask(b, tagger), docs.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn(
            "n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
            .cast(docs.schema["n_chars"].dataType))
    return masked
