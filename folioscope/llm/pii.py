"""Personal data: fixed patterns, and what a character-level bidirectional LSTM with CRF transitions adds to them.

The patterns give the base spans (email, ip, card, phone). The network, written in numpy, learns from labelled spans:
a bounded sample of distinct windows around base spans and around quoted secrets (SAMPLE of each kind, by a hash of the
window; QUIET windows without any), each once as it is and VARIANTS times with its span written as people write
it to get past patterns: spelled-out or bracketed signs, blanks around them, other separators, no plus. It reads every
character of a text in both directions, in overlapping windows. Where two overlap, scores are averaged, weighted by
how far inside its window a character is, and one Viterbi pass over the whole text decides on tags (outside, begin or inside of a
kind). A decoded span is added if it doesn't touch a base span, its tags beat "outside" by MARGIN on average, and it
holds what its kind must hold (four numbers up to 255, digits that pass Luhn, an address once the spelled-out signs are
put back, ...). Besides the kinds of the patterns the network adds `secret`, long random tokens, listed after them.

Offsets are code points, ends exclusive. Null text is empty and has no spans. Texts are read whole; time and memory
grow linearly with them. Rows of null or shared ids are judged each by its own text, repeated rows alike; extra columns
are not read. Without spans to learn from, as in an empty table, nothing is added.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import discard, documents, find_code, sent, stored

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
#: The base patterns, fixed values of the contract: email is LOCAL*@ and DOMAIN, ip is four of a DOTTED chain.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Labels of secrets: a quoted run of letters and digits that is assigned to something.
SECRET = re.compile(r"[=:] ?\"([A-Za-z0-9+/_=-]{20,})\"")

SAMPLE, QUIET, VARIANTS, AROUND = 300, 600, 2, 48
#: Characters of the windows that are decoded, how far they overlap, and how many go together; characters of those learned from.
WINDOW, OVERLAP, TOGETHER = 256, 24, 1024
TAUGHT = 160
HIDDEN, STEPS, BATCH, RATE = 8, 500, 40, 0.02
MARGIN = 1.0
TAGS = 1 + 2 * len(ALL)
#: Characters that are a kind of their own, besides letters, which are in either case one kind each and carry it in CASE.
ALONE = "@.-_+%()/:, \n=[]{}\"'<>|"
INPUTS = 1 + 1 + 26 + 1 + len(ALONE) + 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small(number: str) -> bool:
    """Whether a run of digits is at most 255, however long it is."""
    n = number.lstrip("0")
    return len(n) < 3 or len(n) == 3 and n <= "255"


def emails(text: str):
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and apart, in linear time: from each sign to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            lo = at
            while lo > done and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at:
                yield lo, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def addresses(text: str):
    """Spans of four dotted numbers, leftmost and apart: a chain of numbers is cut into fours from its start."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(small, four)):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and then start."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(1, s, e) for s, e in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 40:  # 19 digits and what stands between
                d = re.sub("[ -]", "", m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def random_looking(token: str) -> bool:
    n = len(token)
    share = np.unique(list(token), return_counts=True)[1] / n
    return n >= 20 and bool(DIGIT.search(token)) and any(c.isalpha() for c in token) and float(-(share * np.log2(share)).sum()) >= 3.0


def labelled(text: str) -> list[tuple[int, int, int]]:
    """What the network is taught: base spans, and secrets that touch none."""
    base = base_spans(text)
    more = [(4, *m.span(1)) for m in SECRET.finditer(text) if random_looking(m.group(1))] if '"' in text else []
    return base + [x for x in more if all(x[2] <= s or e <= x[1] for _, s, e in base)]


AT, DOT = re.compile(r"\s*(?:[(\[{<]\s*(?:at|@)\s*[)\]}>]|\s(?:at|AT)\s|@)\s*", re.I), re.compile(r"\s*(?:[(\[{<]\s*(?:dot|\.)\s*[)\]}>]|\s(?:dot|DOT)\s|\.)\s*", re.I)


def holds(kind: int, span: str) -> bool:
    """Whether a decoded span holds what its kind must."""
    digits = "".join(DIGIT.findall(span))
    if kind == 0:
        plain = DOT.sub(".", AT.sub("@", span.strip()))
        return plain.count("@") == 1 and [*emails(plain)] == [(0, len(plain))]
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(map(small, parts)) and not re.search(r"[^0-9.\s\[\](){}]", span)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", span)
    if kind == 3:
        return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", span) and len(re.findall("[0-9]+", span)) > 1
    return random_looking(span)


def variant(kind: int, span: str, rng: random.Random) -> str:
    """The span as the patterns don't know it."""
    if kind == 0:
        local, _, domain = span.partition("@")
        at = rng.choice([" (at) ", "(at)", " [at] ", "[at]", " at ", " AT ", " @ ", "{at}", " <at> "])
        dot = rng.choice([" (dot) ", "(dot)", " [dot] ", "[.]", " dot ", " DOT ", " . "]) if rng.random() < 0.6 or at == " @ " else "."
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice([" . ", "[.]", "(.)", ". ", " .", "{.}"]))
    digits = "".join(DIGIT.findall(span))
    if kind == 2:
        return rng.choice([".", "/", "  ", "_", " - ", ":"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        s, head, rest = rng.choice([" ", "-", ".", "/"]), rng.choice(["", "00" + digits[:-10] + " ", "(0) ", "0"]), digits[-10:]
        return rng.choice([f"{head}({rest[:3]}) {rest[3:6]}{s}{rest[6:]}", f"{head}{rest[:3]}{s}{rest[3:6]}{s}{rest[6:]}", f"{head}{rest[:3]}/{rest[3:6]}{s}{rest[6:]}"])
    alphabet = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEF0123456789"])
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 48)))


def table_of_kinds() -> np.ndarray:
    """By code point, up to 128 for all beyond ASCII: padding is 0, then digits, letters, capitals' mark, single characters, other, beyond."""
    out = np.full(129, INPUTS - 2, np.uint8)
    out[48:58] = 1
    out[97:123] = out[65:91] = np.arange(2, 28)
    out[9] = out[13] = 29 + ALONE.index(" ")
    for i, a in enumerate(ALONE):
        out[ord(a)] = 29 + i
    out[128] = INPUTS - 1
    return out


TABLE = table_of_kinds()


def kinds_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(c, 128)]


def tags_of(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, s, e in spans:
        if not out[s:e].any():
            out[s], out[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
    return out


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): a curve like tanh, of which half and a half is one like the sigmoid."""
    return x / (1 + np.abs(x))


class Network:
    """Bidirectional LSTM over kinds of characters, a linear layer, and CRF transitions. Gates: in, forget, out, new."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.6, (INPUTS, 4 * h)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.6 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), 2 * np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, TAGS)).astype(np.float32)
        self.p["ob"] = np.zeros(TAGS, np.float32)
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)

    def run(self, x: np.ndarray, d: str):
        """Hidden states over time of one direction, and what back() needs. x: kinds, time first."""
        n, b, h = *x.shape, HIDDEN
        w, u = self.p["w" + d] + self.p["c" + d], self.p["u" + d]
        hs, c = np.zeros((n + 1, b, h), w.dtype), np.zeros((b, h), w.dtype)
        cs, gs = np.zeros((n + 1, b, h), w.dtype), np.zeros((n, b, 4 * h), w.dtype)
        for t in range(n):
            z = soft(w[x[t]] + hs[t] @ u)
            z[:, : 3 * h] = z[:, : 3 * h] * 0.5 + 0.5
            c = z[:, h : 2 * h] * c + z[:, :h] * z[:, 3 * h :]
            hs[t + 1] = z[:, 2 * h : 3 * h] * soft(c)
            cs[t + 1], gs[t] = c, z
        return hs, cs, gs

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """The hidden states of run() alone, units before windows: so each gate is one stretch of memory."""
        n, b, h = *x.shape, HIDDEN
        w, u = np.ascontiguousarray((self.p["w" + d] + self.p["c" + d]).T), np.ascontiguousarray(self.p["u" + d].T)
        hs, c = np.zeros((n + 1, h, b), w.dtype), np.zeros((h, b), w.dtype)
        z, m, s = np.empty((4 * h, b), w.dtype), np.empty((4 * h, b), w.dtype), np.empty((h, b), w.dtype)
        gates, (i, f, o, j) = z[: 3 * h], (z[k * h : (k + 1) * h] for k in range(4))
        for t in range(n):
            np.take(w, x[t], axis=1, out=z, mode="clip")
            np.matmul(u, hs[t], out=m)
            z += m
            np.abs(z, out=m)
            m += 1
            z /= m
            gates *= 0.5
            gates += 0.5
            c *= f
            np.multiply(i, j, out=s)
            c += s
            np.abs(c, out=s)
            s += 1
            np.divide(c, s, out=s)
            np.multiply(o, s, out=hs[t + 1])
        return hs[1:]

    def back(self, x: np.ndarray, d: str, held, dh: np.ndarray, grad: dict) -> None:
        hs, cs, gs = held
        n, b, h = *x.shape, HIDDEN
        u = self.p["u" + d]
        du, dz_all = np.zeros_like(u), np.zeros((n, b, 4 * h), u.dtype)
        nh, nc = np.zeros((b, h), u.dtype), np.zeros((b, h), u.dtype)
        for t in reversed(range(n)):
            i, f, o, j = (gs[t][:, k * h : (k + 1) * h] for k in range(4))
            s = soft(cs[t + 1])
            a = dh[t] + nh
            c = nc + a * o * (1 - np.abs(s)) ** 2
            slope = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
            dz = np.concatenate([c * j * slope(i), c * cs[t] * slope(f), a * s * slope(o), c * i * (1 - np.abs(j)) ** 2], 1)
            dz_all[t] = dz
            du += hs[t].T @ dz
            nh, nc = dz @ u.T, c * f
        grad["u" + d] = du
        grad["c" + d] = dz_all.sum((0, 1))
        grad["w" + d] = np.zeros_like(self.p["w" + d])
        np.add.at(grad["w" + d], x, dz_all)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores, time first."""
        f, b, o = self.states(x, "f"), self.states(x[::-1], "b")[::-1], self.p["o"]
        e = np.matmul(f.transpose(0, 2, 1), o[:HIDDEN])
        for t in range(len(e)):
            e[t] += b[t].T @ o[HIDDEN:]
        e += self.p["ob"]
        return e

    def learn(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y, and its gradient. Padding (kind 0) is tagged outside."""
        held_f, held_b = self.run(x, "f"), self.run(x[::-1], "b")
        hid = np.concatenate([held_f[0][1:], held_b[0][1:][::-1]], 2)
        e = hid @ self.p["o"] + self.p["ob"]
        n, b, _ = e.shape
        t = self.p["t"]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[0] = e[0]

        def lse(v, axis):
            m = v.max(axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

        for i in range(1, n):
            fwd[i] = e[i] + lse(fwd[i - 1][:, :, None] + t, 1)
        for i in reversed(range(n - 1)):
            bwd[i] = lse(t + (e[i + 1] + bwd[i + 1])[:, None, :], 2)
        z = lse(fwd[-1], 1)
        at = np.arange(b)
        gold = sum(e[i, at, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n))
        de = np.exp(fwd + bwd - z[None, :, None])
        dt = np.zeros_like(t)
        for i in range(1, n):
            dt += np.exp(fwd[i - 1][:, :, None] + t + (e[i] + bwd[i])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dt, (y[i - 1], y[i]), -1)
        for i in range(n):
            de[i, at, y[i]] -= 1
        de, grad = (de / b).astype(e.dtype), {"t": dt / b}
        grad["o"], grad["ob"] = np.tensordot(hid, de, ((0, 1), (0, 1))), de.sum((0, 1))
        dh = de @ self.p["o"].T
        self.back(x, "f", held_f, dh[:, :, :HIDDEN], grad)
        self.back(x[::-1], "b", held_b, dh[::-1, :, HIDDEN:], grad)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam over random batches of windows (rows of x and y)."""
        if not len(x):
            self.p["ob"][0] = 50
            return
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            i = rng.integers(0, len(x), BATCH)
            _, grad = self.learn(x[i].T, y[i].T)
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def sure(self, e: np.ndarray) -> np.ndarray:
        """Places where the best path must be outside. A run of other tags gains at most the sum of v over it and what its end adds;
        a place is sure if no run through it can gain anything, and the best run through it is one of two largest sums."""
        t = self.p["t"].astype(np.float64)
        best = e[:, 1].copy()
        for k in range(2, TAGS):
            np.maximum(best, e[:, k], out=best)
        v = (best - e[:, 0]).astype(np.float64) + t[:, 1:].max() - t[0, 0]
        end = t[1:, 0].max() - t[0, 0]
        c = np.concatenate([[0.0], np.cumsum(v)])
        before = c[1:] - np.minimum.accumulate(c[:-1])  # the best run that ends here
        after = np.maximum.accumulate(c[:0:-1])[::-1] - c[:-1]  # the best one that starts here
        return before + after - v + end < -1e-6

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best paths of several stretches at once. e: time, stretch, tag."""
        t, best, back = self.p["t"], e[0], []
        for i in range(1, len(e)):
            s = best[:, :, None] + t
            back.append(s.argmax(1).astype(np.uint8))
            best = s.max(1) + e[i]
        path, at = [best.argmax(1)], np.arange(e.shape[1])
        for b in reversed(back):
            path.append(b[at, path[-1]])
        return np.stack(path[::-1])

    def path(self, e: np.ndarray) -> np.ndarray:
        """The best path over a whole text, which stands between outside characters: Viterbi on the stretches between sure places."""
        out = np.zeros(len(e), np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[1], self.sure(e).astype(np.int8), [1]])))
        lo, hi = edge[::2], edge[1::2]
        order = np.argsort(hi - lo, kind="stable")
        for at in range(0, len(order), TOGETHER):
            part = order[at : at + TOGETHER].tolist()
            held = np.full((int((hi - lo)[part].max()) + 2, len(part), TAGS), -1e6, np.float32)
            held[:, :, 0] = 0
            for c, k in enumerate(part):
                held[1 : 1 + hi[k] - lo[k], c] = e[lo[k] : hi[k]]
            got = self.viterbi(held)
            for c, k in enumerate(part):
                out[lo[k] : hi[k]] = got[1 : 1 + hi[k] - lo[k], c]
        return out


#: What a window counts for where it overlaps the one before and the one after; both together count once.
RISE = (np.arange(1, OVERLAP + 1) / (OVERLAP + 1)).astype(np.float32)[:, None, None]


def scores(network: Network, kinds: list[np.ndarray]) -> list[np.ndarray]:
    """Tag scores of every character of every text, from overlapping windows over each whole text."""
    stride = WINDOW - OVERLAP
    starts = [np.arange(0, max(len(k) - OVERLAP, 1), stride) for k in kinds]
    base = np.cumsum([0, *map(len, kinds)])
    flat = np.concatenate([*kinds, np.zeros(WINDOW, np.uint8)])
    of = np.repeat(np.arange(len(kinds)), [len(s) for s in starts])
    own = np.concatenate(starts) if len(of) else np.zeros(0, np.int64)
    start, room = own + base[of], base[of + 1] - base[of] - own
    total = np.zeros((base[-1], TAGS), np.float32)
    for at in range(0, len(start), TOGETHER):
        s, r, before = start[at : at + TOGETHER], room[at : at + TOGETHER], own[at : at + TOGETHER] > 0
        x = flat[s[None, :] + np.arange(WINDOW)[:, None]]
        x[np.arange(WINDOW)[:, None] >= r[None, :]] = 0
        e = network.emissions(x)
        e[:OVERLAP, before] *= RISE
        e[WINDOW - OVERLAP :, r > WINDOW] *= RISE[::-1]
        for c, (lo, n) in enumerate(zip(s.tolist(), np.minimum(r, WINDOW).tolist(), strict=True)):
            total[lo : lo + n] += e[:n, c]
    return [total[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


#: How far a span is led on to the ends of the words in which it starts and ends.
WORD = 64


def whole_words(text: str, lo: int, hi: int) -> tuple[int, int]:
    s, e = lo, hi
    while 0 < s and s > lo - WORD and s < hi and text[s].isalnum() and text[s - 1].isalnum():
        s -= 1
    while e < len(text) and e < hi + WORD and e > lo and text[e].isalnum() and text[e - 1].isalnum():
        e += 1
    return s, e


def decoded(network: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text, before they are held against the base ones."""
    out: list[list] = []
    for text, e in zip(texts, scores(network, [kinds_of(t) for t in texts]), strict=True):
        path, found, at = network.path(e), [], 0
        marks = np.flatnonzero(path)
        while at < len(marks):
            s = int(marks[at])
            k, end = (int(path[s]) - 1) // 2, s + 1
            while end < len(path) and path[end] == 2 + 2 * k:
                end += 1
            own = np.arange(s, end)
            if float((e[own, path[own]] - e[own, 0]).mean()) >= MARGIN:
                lo, hi = s, end
                while lo < hi and text[lo].isspace():
                    lo += 1
                while lo < hi and text[hi - 1].isspace():
                    hi -= 1
                lo, hi = whole_words(text, lo, hi)
                if holds(k, text[lo:hi]):
                    found.append((k, lo, hi))
            at = int(np.searchsorted(marks, end))
        out.append(found)
    return out


def pieces(text: str, chance: float) -> list[tuple[int, str, int, int]]:
    """(kind, window, first, last) around every labelled span that stands alone in its window, and at times a window without any (kind -1)."""
    spans, out = labelled(text), []
    for k, s, e in spans:
        if e - s <= TAUGHT - 2 * AROUND:
            lo, hi = max(0, s - AROUND), min(len(text), e + AROUND)
            while any(a < lo < b for _, a, b in spans):
                lo += 1
            while any(a < hi < b for _, a, b in spans):
                hi -= 1
            if not any((a, b) != (s, e) and a < hi and lo < b for _, a, b in spans):
                out.append((k, text[lo:hi], s - lo, e - lo))
    h = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    if text and h % (1 << 30) < chance * (1 << 30):
        lo = (h >> 30) % max(1, len(text) - TAUGHT)
        if not any(s < lo + TAUGHT and lo < e for _, s, e in spans):
            out.append((-1, text[lo : lo + TAUGHT], 0, 0))
    return out


def sampled(df: DataFrame, text: str) -> list:
    """Rows k, t, s, e: about SAMPLE distinct windows of each kind and QUIET without a span, chosen by a hash of the window."""
    rows = df.select(F.col(text).alias("t")).filter("t is not null")
    n = rows.count()

    def run(batches):
        for b in batches:
            got = [p for t in b.column(0).to_pylist() for p in pieces(t, min(1.0, 4 * QUIET / max(n, 1)))]
            cols = list(zip(*got, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["k", "t", "s", "e"])

    find_code(df.sparkSession)
    held = stored(rows.mapInArrow(run, "k int, t string, s int, e int").distinct(), "labelled-windows")
    by = {r.k: r.n for r in held.groupBy("k").agg(F.count("*").alias("n")).collect()}
    rate = F.create_map(*[F.lit(x) for k, m in by.items() for x in (k, min(1.0, (SAMPLE if k >= 0 else QUIET) / m))]) if by else F.create_map(F.lit(-1), F.lit(0.0))
    share = F.pmod(F.xxhash64("t", "s"), F.lit(1 << 30)) / float(1 << 30)
    out = sorted(held.filter(share < rate[F.col("k")]).collect(), key=lambda r: (r.k, r.t, r.s))
    discard(held)
    return out


def fit(df: DataFrame, text: str = "text") -> Network:
    """Learn from sampled windows, each as it is and with VARIANTS ways to write its span."""
    xs, ys, rng = [], [], random.Random(0)
    rows = sampled(df, text)
    for r in rows:
        for i in range(1 + VARIANTS * (r.k >= 0)):
            span = variant(r.k, r.t[r.s : r.e], rng) if i else r.t[r.s : r.e]
            t = (r.t[: r.s] + span + r.t[r.e :])[:TAUGHT]
            x, y = np.zeros(TAUGHT, np.uint8), np.zeros(TAUGHT, np.int64)
            x[: len(t)] = kinds_of(t)
            if r.k >= 0 and r.s + len(span) <= len(t):
                y[: len(t)] = tags_of([(r.k, r.s, r.s + len(span))], len(t))
            xs.append(x)
            ys.append(y)
    network = Network()
    if any(r.k >= 0 for r in rows):
        network.fit(np.array(xs), np.array(ys))
    else:
        network.fit(np.zeros((0, TAUGHT)), np.zeros((0, TAUGHT)))
    return network


def added_spans(network: Network, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    return [[x for x in more if all(x[2] <= s or e <= x[1] for _, s, e in own)] for own, more in zip(base, decoded(network, texts), strict=True)]


#: Characters of the texts that are decoded together; longer texts alone.
PART = 1 << 18


def detect(df: DataFrame, network: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, finish)."""
    ready = sent(df.sparkSession, network)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("finish", pa.int64())])

    def named(rows: list) -> pa.Array:
        return pa.array([[{"kind": ALL[k], "start": s, "finish": e} for k, s, e in r] for r in rows], pa.list_(span))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base, added, seen = [], [], {}
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PART):
                    size += len(texts[stop])
                    stop += 1
                new = [t for t in dict.fromkeys(texts[at:stop]) if t not in seen]
                own = [base_spans(t) for t in new]
                seen |= dict(zip(new, zip(own, added_spans(ready.value, new, own), strict=True), strict=True))
                base += [seen[t][0] for t in texts[at:stop]]
                added += [seen[t][1] for t in texts[at:stop]]
                at = stop
            yield pa.RecordBatch.from_arrays([b.column(0), named(base), named(added)], ["doc_id", "base", "added"])

    kind = df.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,finish:long>>"
    find_code(df.sparkSession)
    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by the name of its kind; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])


def listed(spans) -> str:
    return "concat_ws(',', transform(" + spans + ", x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.finish as string))))"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = detect(docs, fit(docs))
    kinds = "array(" + ", ".join(f"'{k}'" for k in ALL) + ")"
    order = f"array_sort(concat(base, added), (a, b) -> case when a.kind = b.kind then cast(sign(a.start - b.start) as int) else cast(sign(array_position({kinds}, a.kind) - array_position({kinds}, b.kind)) as int) end)"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed(order)).alias("spans"),
        F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
