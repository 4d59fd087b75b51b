"""Personal data: patterns plus a character BiLSTM-CRF.

The tagger reads characters in both directions with two LSTMs and scores tag
sequences with CRF transitions. It is trained here, in numpy, from labelled
spans: any (text, spans) pairs, by default generated sentences in which
addresses, numbers and look-alikes (versions, prices, dates, order numbers)
stand in invented prose.

The tagger reads every character of every text, cut into overlapping windows.
Windows are decoded one by one and reconciled over the whole text: each
character takes its tag from the window whose edges are farthest from it, then
spans are read off the joined tags. A span that the tagger adds must look like
its kind (see plausible) and overlap no span found by pattern; those all stay.

Defined results: a null text counts as empty; positions are code points, ends
exclusive; rows that repeat are scanned each; of columns only those asked for
and the text are read, so others may have any name. A very long text is
decoded DECODED windows at a time and holds about ten bytes a character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinloom.llm.common import map_batches, own_names, with_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: A match can only begin where a run of digits does, and no part gives digits back; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _part(text: str) -> bool:
    text = text.lstrip("0")
    return len(text) <= 3 and int(text or 0) <= 255


def patterns(text: str) -> list[Span]:
    """Spans found by pattern, leftmost and non-overlapping within a kind; by start, then kind."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        if all(map(_part, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the tagger ---------------------------------------------------------------------------------

#: Characters of a window and from one window to the next; a character is at least half the overlap from an edge of its window.
WINDOW, STRIDE = 512, 448
#: Characters of a training example.
EXAMPLE = 96
HIDDEN = 12
SYMBOLS = 100  # 0: nothing; 1-95: printable ASCII; 96-99: other letters, digits, spaces, rest
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Windows decoded at once.
DECODED = 3072

#: Code point -> symbol, 0 where it has not been met yet.
_symbol_of = np.zeros(0x110000, np.uint8)
_symbol_of[32:127] = np.arange(1, 96)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _symbol_of[points]
    if not out.all():
        for p in np.unique(points[out == 0]).tolist():
            c = chr(p)
            _symbol_of[p] = 96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99
        out = _symbol_of[points]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray):
    """States of one direction over symbols x (rows, steps); table: symbol -> gate inputs."""
    rows, steps = x.shape
    h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    out, kept = np.empty((steps, rows, HIDDEN), np.float32), []
    for s in range(steps):
        z = table[x[:, s]] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        old, before = c, h
        c = f * c + i * g
        t = np.tanh(c)
        h = o * t
        out[s] = h
        kept.append((gates, g, old, t, before))
    return out, kept


def _states(x: np.ndarray, live: np.ndarray, table: np.ndarray, u: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, states of the live rows) of one direction, without what training keeps; x is (steps, rows), states are (HIDDEN, rows).

    A sigmoid is half a tanh of half its input and a half, so one tanh serves all gates.
    """
    half = np.repeat(np.array([0.5, 1], np.float32), [3 * HIDDEN, HIDDEN])
    table, u = np.ascontiguousarray((table * half).T), np.ascontiguousarray((u * half).T)
    h, c = np.zeros((HIDDEN, x.shape[1]), np.float32), np.zeros((HIDDEN, x.shape[1]), np.float32)
    for s in range(len(x)):
        n = int(live[s])
        if not n:
            return
        h, c = h[:, :n], c[:, :n]
        z = u @ h
        z += np.take(table, x[s, :n], axis=1, mode="clip")
        np.tanh(z, out=z)
        gates = z[: 3 * HIDDEN]
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        c = z[HIDDEN : 2 * HIDDEN] * c
        c += z[:HIDDEN] * z[3 * HIDDEN :]
        h = np.tanh(c)
        h *= z[2 * HIDDEN : 3 * HIDDEN]
        yield s, h


def _lstm_back(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray):
    """Gradients of the symbol table and of u."""
    rows, steps = x.shape
    du, parts = np.zeros_like(u), np.empty((steps, rows, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for s in range(steps - 1, -1, -1):
        gates, g, old, t, before = kept[s]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        dh = dh + dout[s]
        dc = dc + dh * o * (1 - t * t)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        parts[s] = dz
        du += before.T @ dz
        dh = dz @ u.T
        dc = dc * f
    which = (x.T.reshape(-1, 1) == np.arange(SYMBOLS)).astype(np.float32)
    return which.T @ parts.reshape(-1, 4 * HIDDEN), du


@dataclass
class Tagger:
    forward: np.ndarray
    forward_u: np.ndarray
    backward: np.ndarray
    backward_u: np.ndarray
    out: np.ndarray  # (2 * HIDDEN + 1, TAGS)
    moves: np.ndarray  # (TAGS, TAGS), CRF transitions

    def parameters(self) -> list[np.ndarray]:
        return [self.forward, self.forward_u, self.backward, self.backward_u, self.out, self.moves]

    @staticmethod
    def fresh(seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        tagger = Tagger(make(SYMBOLS, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN), make(SYMBOLS, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN), make(2 * HIDDEN + 1, TAGS), make(TAGS, TAGS))
        for t in (tagger.forward, tagger.backward):
            t[:, HIDDEN : 2 * HIDDEN] += 1  # forget gates start open
        return tagger

    def emissions(self, x: np.ndarray):
        a, ka = _lstm(x, self.forward, self.forward_u)
        b, kb = _lstm(x[:, ::-1], self.backward, self.backward_u)
        states = np.concatenate([a, b[::-1], np.ones((*a.shape[:2], 1), np.float32)], axis=2)
        return states @ self.out, states, ka, kb

    def decode(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row of symbols (Viterbi); rows by falling size, padded behind it."""
        rows, steps = x.shape
        live = np.searchsorted(-sizes, -np.arange(steps), "left")  # rows that have a step: the first so many
        scores = np.empty((steps, TAGS, rows), np.float32)
        scores[:] = self.out[-1][:, None]
        for s, h in _states(x.T, live, self.forward, self.forward_u):
            scores[s, :, : live[s]] += self.out[:HIDDEN].T @ h
        turned = np.take_along_axis(x, np.maximum(sizes[:, None] - 1 - np.arange(steps), 0), 1)
        back_scores = np.empty_like(scores)
        for s, h in _states(turned.T, live, self.backward, self.backward_u):
            np.matmul(self.out[HIDDEN : 2 * HIDDEN].T, h, out=back_scores[s, :, : live[s]])
        cuts = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            scores[: sizes[lo], :, lo:hi] += back_scores[: sizes[lo], :, lo:hi][::-1]
        # Best scores of all steps; the way back to them is found again only for the tags of the path.
        best, moves = scores, self.moves[:, :, None]
        for s in range(1, steps):
            n = live[s]
            before = best[s - 1][:, :n]
            top = before[0] + moves[0]
            for t in range(1, TAGS):
                np.maximum(top, before[t] + moves[t], out=top)
            best[s][:, :n] += top
        tags = np.zeros((steps, rows), np.int8)
        now, into = np.zeros(rows, np.int64), np.ascontiguousarray(self.moves)
        for s in range(steps - 1, -1, -1):
            n, on = live[s], live[s + 1] if s + 1 < steps else 0
            if on:
                now[:on] = (best[s][:, :on] + np.take(into, now[:on], axis=1)).argmax(axis=0)
            now[on:n] = best[s][:, on:n].argmax(axis=0)
            tags[s, :n] = now[:n]
        return tags.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean negative log-likelihood, by forward-backward over the CRF."""
        scores, states, ka, kb = self.emissions(x)
        steps, rows, _ = scores.shape
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for s in range(1, steps):
            alpha[s] = _logsumexp(alpha[s - 1][:, :, None] + self.moves, 1) + scores[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = _logsumexp(self.moves + (scores[s + 1] + beta[s + 1])[:, None, :], 2)
        whole = _logsumexp(alpha[-1], 1)
        ds = np.exp(alpha + beta - whole[None, :, None])
        dm = np.exp(alpha[:-1, :, :, None] + self.moves + (scores[1:] + beta[1:])[:, :, None, :] - whole[None, :, None, None]).sum(axis=(0, 1))
        s, r = np.meshgrid(np.arange(steps), np.arange(rows), indexing="ij")
        ds[s, r, y.T] -= 1
        np.subtract.at(dm, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds /= rows
        dstates = ds @ self.out.T
        dout = np.einsum("srh,srt->ht", states, ds)
        df, dfu = _lstm_back(x, self.forward_u, ka, dstates[:, :, :HIDDEN])
        db, dbu = _lstm_back(x[:, ::-1], self.backward_u, kb, dstates[::-1, :, HIDDEN : 2 * HIDDEN])
        return [df, dfu, db, dbu, dout, dm / rows]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def tagged(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """One training example: symbols and tags, cut or padded to EXAMPLE."""
    y = np.zeros(len(text), np.int64)
    for kind, s, e in spans:
        y[s:e] = 2 + 2 * KINDS.index(kind)
        y[s] -= 1
    x = symbols(text)[:EXAMPLE]
    return np.pad(x, (0, EXAMPLE - len(x))), np.pad(y[:EXAMPLE], (0, EXAMPLE - len(x)))


def train(labelled: list[tuple[str, list[Span]]], epochs: int = 16, batch: int = 64, rate: float = 0.015, seed: int = 5) -> Tagger:
    """A tagger learnt from labelled texts by Adam on clipped gradients."""
    xs, ys = (np.array(v) for v in zip(*(tagged(*e) for e in labelled), strict=True))
    r, tagger = np.random.default_rng(seed), Tagger.fresh(seed)
    ps = tagger.parameters()
    m, v, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    for epoch in range(epochs):
        order = r.permutation(len(xs))
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            gs = tagger.gradients(xs[take], ys[take])
            size = np.sqrt(sum(float((g * g).sum()) for g in gs))
            step += 1
            for p, g, a, b in zip(ps, gs, m, v, strict=True):
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * 0.85**epoch * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return tagger


def examples(n: int = 3000, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Generated sentences with labelled spans."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[r.integers(len(xs))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    syllables = "an ber con de er fi ga ho in ja ka lo mi nes or pa que ri st th un ver wa zu é ü ñ ç".split()
    word = lambda: "".join(syllables[i] for i in r.integers(0, len(syllables), r.integers(1, 4)))

    def cased() -> str:
        w = word()
        return pick(w, w, w, w.capitalize(), w.upper()) + pick("", "", "", "", ",", ".", "!!", "***", "$$$", "###", "%%%", "&&&")

    def plain() -> str:
        return "".join(c for c in word() if c.isascii()) or "x"

    def card() -> str:
        body = pick("4", "5", "37", "6011") + digits(14)
        body = body[: int(pick(14, 15, 15, 15, 17))]
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return body if r.random() < 0.5 else pick(" ", "-").join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        return pick(f"+{r.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{r.integers(10, 99)}{digits(9)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{r.integers(10, 99)} {digits(3)} {digits(6)}")

    def email() -> str:
        return pick(plain(), f"{plain()}.{plain()}", f"{plain()}{digits(2)}", f"{plain()}.{digits(2)}", f"{plain()}_{plain()}") + "@" + pick(plain(), f"mail{digits(1)}.{plain()}", f"{plain()}-{plain()}") + "." + pick("com", "org", "net", "de", "fr", "es", "example")

    make = {"email": email, "ip": lambda: ".".join(str(x) for x in r.integers(0, 256, 4)), "card": card, "phone": phone}
    other = [lambda: f"{r.integers(0, 20)}.{r.integers(0, 20)}", lambda: f"{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 20)}", lambda: digits(int(r.integers(1, 10))), lambda: f"{r.integers(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "".join(pick(*"0123456789abcdef") for _ in range(32)), lambda: f"token = \"{''.join(pick(*'0123456789abcdef') for _ in range(32))}\"", lambda: digits(int(r.integers(20, 30))), lambda: f"@{plain()}", lambda: f"{digits(4)}/{digits(2)}", lambda: f"Version {r.integers(0, 9)}.0."]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < EXAMPLE:
            roll = r.random()
            if roll < 0.16:
                kind = pick(*KINDS)
                value = make[kind]()
                if len(text) + len(value) < EXAMPLE:
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                    if r.random() < 0.2:
                        text += pick(".", ",", "***", "###", "!!")
            elif roll < 0.28:
                text += pick(*other)()
            else:
                text += cased()
            text += pick(" ", " ", " ", " ", "\n")
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def default_tagger() -> Tagger:
    return train(examples())


def plausible(kind: str, value: str) -> bool:
    """What a span added by the tagger must look like."""
    n = sum(c.isdigit() for c in value)
    if value != value.strip() or "\n" in value:
        return False
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", value) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) is not None and all(map(_part, value.split(".")))
    if kind == "card":
        return 13 <= n <= 19 and re.fullmatch(r"[0-9][0-9 .-]+[0-9]", value) is not None and luhn("".join(c for c in value if c.isdigit()))
    return 7 <= n <= 15 and re.fullmatch(r"[+(0-9][0-9 ().-]+[0-9]", value) is not None and not value.isdigit()


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The overlapping windows (start, end) that cover a text."""
    for w in range(0, max(min(len(text), 1), len(text) - WINDOW + STRIDE), STRIDE):
        yield w, min(w + WINDOW, len(text))


class Reconciled:
    """The tags of one text: each character takes its tag from the window whose edges are farthest from it (three bytes a character)."""

    def __init__(self, text: str):
        self.length = len(text)
        self.tags, self.margin = np.zeros(len(text), np.int8), np.full(len(text), -1, np.int16)

    def add(self, start: int, stop: int, found: np.ndarray) -> None:
        size = stop - start
        left = np.arange(size) if start else np.full(size, WINDOW)
        right = np.arange(size - 1, -1, -1) if stop < self.length else np.full(size, WINDOW)
        margin = np.minimum(left, right)
        farther = np.flatnonzero(margin > self.margin[start:stop])
        self.margin[start + farther] = margin[farther]
        self.tags[start + farther] = found[farther]

    def spans(self) -> list[Span]:
        """B or a changed kind begins a span."""
        out: list[list] = []
        for at in np.flatnonzero(self.tags).tolist():
            tag = int(self.tags[at])
            kind = KINDS[(tag - 1) // 2]
            if out and out[-1][2] == at and out[-1][0] == kind and tag % 2 == 0:
                out[-1][2] = at + 1
            else:
                out.append([kind, at, at + 1])
        return [tuple(x) for x in out]


def detect(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans found by pattern, and those with the tagger's.

    Windows of neighbouring texts are decoded DECODED at a time; only texts
    that have windows among those hold tags.
    """
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    open_texts: dict[int, Reconciled] = {}

    def close(upto: int) -> None:
        for r in [r for r in open_texts if r < upto]:
            t, base = texts[r], patterns(texts[r])
            added = [x for x in open_texts.pop(r).spans() if plausible(x[0], t[x[1] : x[2]])]
            spans = list(base)
            if added:
                taken = np.zeros(len(t), bool)
                for _, s, e in base:
                    taken[s:e] = True
                spans += [x for x in added if not taken[x[1] : x[2]].any()]
            out[r] = base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    every = ((r, w, stop) for r, t in enumerate(texts) for w, stop in windows(t))
    while some := list(islice(every, DECODED)):
        sizes = np.array([stop - w for _, w, stop in some])
        order = np.argsort(-sizes, kind="stable")
        rows = np.zeros((len(some), int(sizes.max())), np.uint8)
        for k, n in enumerate(order):
            r, w, stop = some[n]
            rows[k, : stop - w] = symbols(texts[r][w:stop])
        for n, found in zip(order, tagger.decode(rows, sizes[order]), strict=True):
            r, w, stop = some[n]
            if r not in open_texts:
                open_texts[r] = Reconciled(texts[r])
            open_texts[r].add(w, stop, found)
        close(some[-1][0])
    close(len(texts))
    return out


NAMES = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scanned(df: DataFrame, keep: list[str], tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """Columns `keep` with n_email, n_ip, n_card, n_phone and base_sha256 of the pattern spans, and all spans."""
    shared = df.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    rows, fields = with_text(df, keep, text)
    names = own_names(NAMES, keep)

    def kernel():
        def each(batch):
            found = detect(shared.value, [x or "" for x in batch.column(len(keep)).to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, pa.array(digest, pa.string()), pa.array([joined(spans) for _, spans in found], pa.string())], [*keep, *names])

        return each

    types = ["long"] * len(KINDS) + ["string", "string"]
    return map_batches(rows, kernel, ", ".join([*filter(None, [fields]), *(f"`{n}` {t}" for n, t in zip(names, types, strict=True))]))
