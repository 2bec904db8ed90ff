"""Personal data in texts: fixed patterns, and what a character-level tagger finds beside them.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top, written and trained in numpy. Its
gates are piecewise linear (``clip``), its inputs a table of columns by class of character. It is learnt from labelled spans: the
patterns' own matches in a bounded sample of the texts, and variants that the patterns don't cover
(``name at host dot com``, phone numbers without ``+``, dotted cards) set into stretches of the sample.

Every text is read whole, in windows of ``WIDTH`` characters that overlap by ``2 * MARGIN``. Each window is decoded by itself; the tag of a
character is that of the window in which it lies furthest from an edge, and spans are read off the tags of the whole text, across windows.
A window in which no label can win is told by a bound on what any path could gain, without decoding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import durable, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Hidden units of a direction, length of a window, what it has on each side to look at only, windows that run together.
HIDDEN, WIDTH, MARGIN, TOGETHER = 8, 320, 24, 2048
STEP = WIDTH - 2 * MARGIN
#: Documents, and windows of them, that a fit takes at most; length of a window of the fit; what beginning a label costs beyond what was learnt.
SAMPLE, SAMPLE_WINDOWS, FIT_WIDTH, CAUTION = 700, 1500, 96, 3.0
#: Weight of the characters' own likelihood beside that of the whole sequence.
ALONE = 0.3
#: Classes of characters: ASCII, all others, nothing.
BEYOND, NOTHING, CLASSES = 128, 129, 130
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind

# --- the fixed patterns, each read in one pass over a text of any shape


LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """At each ``@``: the name that ends there and the host that begins there. A long run of name characters is looked at once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done:  # back over the name, a few characters at a time
            a = max(done, start - 64)
            stops = [m.end() for m in NOT_LOCAL.finditer(text, a, start)]
            start = a + (stops[-1] - a if stops else 0)
            if stops:
                break
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their tests, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# --- the tagger


def groups() -> np.ndarray:
    """Kinds of characters that share a part of their input: digits, letters, and each other character that the patterns know."""
    out = np.full(CLASSES, 0)
    for g, chars in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-_", "+", "(", ")", " ", "\n\t\r", ":;,", "/\\", "[]{}<>"), 1):
        for c in chars:
            out[ord(c)] = g
    out[BEYOND], out[NOTHING] = 15, 16
    return out


GROUP = groups()
#: Characters without a part of their own: digits are all alike.
SHARED = np.isin(np.arange(CLASSES), [*range(48, 58), BEYOND, NOTHING])


def classes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), BEYOND).astype(np.uint8)


@dataclass
class Tagger:
    """Of each direction: the table of inputs by class (4 HIDDEN x CLASSES; gates in, forget, out, then the candidate) and the recurrent weights; the layer to the tags; the CRF's transitions, first and last tags."""

    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def states(self, x: np.ndarray) -> np.ndarray:
        """``x``: classes (time, window). Hidden states (time, both directions, window). Characters of class NOTHING leave no trace: their gates are shut."""
        steps, n = x.shape
        h3, h4 = 3 * HIDDEN, 4 * HIDDEN
        both = np.empty((steps, 2 * HIDDEN, n), np.float32)
        gates, more, part = np.empty((h4, n), np.float32), np.empty((h4, n), np.float32), np.empty((HIDDEN, n), np.float32)
        for d in range(2):
            table, u = self.table[d], self.recurrent[d]
            cell, h = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table, x[t], axis=1, out=gates, mode="clip")
                np.matmul(u, h, out=more)
                np.add(gates, more, out=gates)
                np.clip(gates[:h3], 0, 1, out=gates[:h3])
                np.clip(gates[h3:], -1, 1, out=gates[h3:])
                np.multiply(gates[:HIDDEN], gates[h3:], out=part)
                np.multiply(cell, gates[HIDDEN : 2 * HIDDEN], out=cell)
                np.add(cell, part, out=cell)
                np.clip(cell, -1, 1, out=cell)
                h = both[t, d * HIDDEN : (d + 1) * HIDDEN]
                np.multiply(gates[2 * HIDDEN : h3], cell, out=h)
        return both

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(self.out, self.states(x)) + self.bias[:, None]

    def can_label(self, e: np.ndarray) -> np.ndarray:
        """Windows in which a path with a label might win. A stretch of n labels has n - 1 steps inside and one at either end; if no
        character gains as much as the dearest of these gives, no stretch does."""
        plain = self.step[0, 0]
        inside = self.step[1:, 1:].max() - plain
        ends = max(self.step[0].max() - plain, (self.first - self.first[0]).max()) + max(self.step[1:, 0].max() - plain, (self.last - self.last[0]).max())
        return (e[:, 1:].max(1) - e[:, 0]).max(0) + max(inside, ends, 0.0) >= 0

    def best(self, e: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest tags (time, window)."""
        steps, _, n = e.shape
        score = self.first[:, None] + e[0]
        back = np.empty((steps, TAGS, n), np.int8)
        for t in range(1, steps):
            ways = score[:, None, :] + self.step[:, :, None]
            back[t] = ways.argmax(0)
            score = ways.max(0) + e[t]
        tags = np.empty((steps, n), np.int8)
        tags[-1] = (score + self.last[:, None]).argmax(0)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][None].astype(np.int64), 0)[0]
        return tags

    def tagged(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``windows``: classes (window, time). The windows that may have labels, and their tags (window, time)."""
        x = np.ascontiguousarray(windows.T)
        e = self.emissions(x)
        some = np.flatnonzero(self.can_label(e))
        return some, self.best(e[:, :, some]).T if len(some) else np.zeros((0, windows.shape[1]), np.int8)


def _windows(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of all texts, at most ``TOGETHER`` of one width at a time: width, windows, texts, where each starts, and (from, to) that it answers for, within the window."""
    held: dict[int, list[tuple[np.ndarray, int, int, int, int]]] = {}

    def give(width):
        rows = held.pop(width)
        x = np.full((len(rows), width), NOTHING, np.uint8)
        for i, r in enumerate(rows):
            x[i, : len(r[0])] = r[0]
        return width, x, *(np.array([r[k] for r in rows]) for k in (1, 2)), np.array([r[3:5] for r in rows])

    for i, text in enumerate(texts):
        n = len(text)
        count = 1 + max(0, -(-(n - WIDTH) // STEP)) if n else 0
        for j0 in range(0, count, TOGETHER):
            j1 = min(count, j0 + TOGETHER)
            part = classes(text[j0 * STEP : (j1 - 1) * STEP + WIDTH])
            for j in range(j0, j1):
                one = part[(j - j0) * STEP : (j - j0) * STEP + WIDTH]
                width = min(WIDTH, -(-len(one) // 32) * 32)
                held.setdefault(width, []).append((one, i, j * STEP, MARGIN if j else 0, len(one) if j == count - 1 else STEP + MARGIN))
                if len(held[width]) == TOGETHER:
                    yield give(width)
    for width in sorted(held):
        yield give(width)


def model_spans(texts: list[str], tagger: Tagger) -> dict[int, list[tuple[int, int, int]]]:
    """Of each text that has any: (start, kind, end) of the tagger's spans, in order."""
    at, tag, text = [], [], []
    for _, windows, owner, start, answers in _windows(texts):
        some, tags = tagger.tagged(windows)
        w, t = np.nonzero(tags)
        ok = (t >= answers[some[w], 0]) & (t < answers[some[w], 1])
        w, t = w[ok], t[ok]
        at.append(start[some[w]] + t), tag.append(tags[w, t]), text.append(owner[some[w]])
    if not at:
        return {}
    at, tag, text = np.concatenate(at), np.concatenate(tag).astype(np.int64), np.concatenate(text)
    order = np.lexsort((at, text))
    at, tag, text = at[order], tag[order], text[order]
    kind = (tag - 1) // 2
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at)) - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(begins.tolist(), ends.tolist(), strict=False):
        found.setdefault(int(text[a]), []).append((int(at[a]), int(kind[a]), int(at[b]) + 1))
    return found


def plausible(kind: int, s: str) -> bool:
    """What a span of the tagger must have to be kept: letters, or as many digits as its kind has; a card its check digit."""
    d = _digits(s)
    if kind == 0:
        return len(s) >= 8 and sum(c.isalpha() for c in s) >= 6 and re.search(r"@|\bat\b|\(at\)|\[at\]", s, re.IGNORECASE) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(map(_small, parts))
    return 12 <= len(d) <= 19 and luhn(d) if kind == 2 else 9 <= len(d) <= 15


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text: the patterns' spans, and the tagger's that touch none of them. Null texts have none."""
    texts = [t or "" for t in texts]
    more, out = model_spans(texts, tagger), []
    for i, text in enumerate(texts):
        base, added = base_spans(text), []
        taken = np.zeros(0, np.int64)
        if i in more:
            taken = np.array([[a, b] for a, _, b in base], np.int64).reshape(-1, 2)
            for a, kind, b in more[i]:
                while a < b and text[a] in " \n\t.,;:":
                    a += 1
                while b > a and text[b - 1] in " \n\t.,;:":
                    b -= 1
                if not ((taken[:, 0] < b) & (taken[:, 1] > a)).any() and plausible(kind, text[a:b]):
                    added.append((a, kind, b))
        out.append((base, added))
    return out


# --- learning


def _instances(rng: np.random.Generator, words: list[str]) -> tuple[str, int]:
    """A made-up piece of personal data and its kind, or something that only looks like it and -1."""
    pick = lambda *a: a[rng.integers(len(a))]
    word = lambda: words[rng.integers(len(words))].lower()
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    name = pick(word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{num(2)}")
    host, end = pick(word(), f"mail{num(1)}.example", f"{word()}-{word()}"), pick("com", "org", "net", "de", "fr", "es")
    case = int(rng.integers(9))
    if case == 0:
        return f"{name}@{host}.{end}", 0
    if case == 1:
        dot = pick(" dot ", "(dot)", " [dot] ", ".")
        at = pick(" [at] ", "(at)", " (at) ", "[at]") if dot == "." else pick(" at ", " [at] ", "(at)", " AT ")
        return f"{name}{at}{host.replace('.', dot)}{dot}{end}", 0
    if case == 2:
        return pick(".", ".", "[.]", " . ", "(.)").join(str(d) for d in rng.integers(0, 256, 4)), 1
    if case in (3, 4):
        d = str(pick(4, 5, 3)) + num(14)
        card = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        sep = "" if case == 3 else pick(" ", "-", ".", "/", "_", "  ")
        return sep.join(card[i : i + 4] for i in range(0, 16, 4)), 2
    if case == 5:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"+{num(2)}.{num(3)}.{num(6)}"), 3
    if case == 6:
        a, b, c = num(3), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {num(2)} {num(4)} {num(4)}", f"({a}){b}-{c}"), 3
    hexes = "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, int(rng.integers(12, 48))))
    return pick(
        f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}.0{num(1)}.20{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)},{num(3)}.{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", num(int(rng.integers(1, 9))), hexes, hexes.upper(),
        f"@{word()}", f"{word()} @ {word()}", f"{word()} at {word()}", f"{word()} at the {word()} dot", f"{word()}.{word()}", f"19{num(2)}-20{num(2)}", f"[{num(2)}]", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{word()}_{hexes}", f"({word()})", f"+{num(2)}", f"{num(3)}-{num(2)}", f"{word()}:{hexes}",
    ), -1


def training_windows(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (window, FIT_WIDTH): the given windows as they are, and each with made-up pieces set in at a place without labels."""
    rng = np.random.default_rng(seed)
    words = sorted({w for text, _ in windows for w in re.findall("[A-Za-z]{3,10}", text)}) or ["alpha", "beta", "gamma", "delta"]
    texts = [(t, s) for t, s in windows]
    plain = [t for t, s in windows if not s] or [" ".join(rng.choice(words, 20)) for _ in range(50)]
    for _ in range(max(1500, 2 * len(windows))):
        base = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, len(base))))
        cut = base.find(" ", at)
        at = cut + 1 if cut >= 0 else len(base)
        piece, kind = _instances(rng, words)
        before = base[max(0, at - int(rng.integers(20, 60))) : at]
        after = ("", " ", ". ", ", ", "\n")[rng.integers(5)] if rng.integers(4) == 0 else " "
        texts.append((before + piece + after + base[at:], [(len(before), kind, len(before) + len(piece))] if kind >= 0 else []))
    x, y = np.full((len(texts), FIT_WIDTH), NOTHING, np.uint8), np.zeros((len(texts), FIT_WIDTH), np.int64)
    for i, (text, spans) in enumerate(texts):
        c = classes(text)[:FIT_WIDTH]
        x[i, : len(c)] = c
        for a, kind, b in spans:
            if a < FIT_WIDTH:
                y[i, a : min(b, FIT_WIDTH)] = 2 + 2 * kind
                y[i, a] = 1 + 2 * kind
    return x, y


def _allowed() -> np.ndarray:
    """Which tags may follow which: an inside only its own kind's begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _crf(e: np.ndarray, y: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the tags ``y`` (time, window), and its gradients to emissions, steps, first and last."""
    steps, _, n = e.shape
    ok = _allowed()
    w = np.where(ok, np.exp(step), 0.0)
    start_ok = np.array([k == 0 or k % 2 == 1 for k in range(TAGS)])
    top = e.max(1, keepdims=True)
    p = np.exp(e - top)
    a, scale = np.empty_like(p), np.empty((steps, n))
    a[0] = np.where(start_ok, np.exp(first), 0.0)[:, None] * p[0]
    for t in range(steps):
        if t:
            a[t] = (w.T @ a[t - 1]) * p[t]
        scale[t] = a[t].sum(0)
        a[t] /= scale[t]
    end = np.exp(last)[:, None]
    z = (a[-1] * end).sum(0)
    b = np.empty_like(p)
    b[-1] = end / z
    g_step = np.zeros_like(step)
    for t in range(steps - 1, 0, -1):
        m = p[t] * b[t] / scale[t]
        b[t - 1] = w @ m
        g_step += w * (a[t - 1] @ m.T)
    gamma = a * b
    ll = np.log(z).sum() + np.log(scale).sum() + top.sum()
    at = np.arange(n)
    gold = sum(e[t, y[t], at].sum() for t in range(steps)) + step[y[:-1], y[1:]].sum() + first[y[0]].sum() + last[y[-1]].sum()
    g_e = gamma.copy()
    for t in range(steps):
        g_e[t, y[t], at] -= 1
    np.add.at(g_step, (y[:-1].ravel(), y[1:].ravel()), -1.0)
    g_first = gamma[0].sum(1) - np.bincount(y[0], minlength=TAGS)
    g_last = gamma[-1].sum(1) - np.bincount(y[-1], minlength=TAGS)
    return float(ll - gold) / n, g_e / n, np.where(ok, g_step, 0.0) / n, g_first / n, g_last / n


def _layer(table: np.ndarray, u: np.ndarray, x: np.ndarray, back: bool) -> tuple:
    """Forward pass of one direction for learning: hidden states, and what the way back needs."""
    steps, n = x.shape
    gates, cells, raw, hs = np.empty((steps, 4 * HIDDEN, n)), np.empty((steps + 1, HIDDEN, n)), np.empty((steps, HIDDEN, n)), np.zeros((steps + 1, HIDDEN, n))
    cells[0] = 0
    order = range(steps - 1, -1, -1) if back else range(steps)
    for s, t in enumerate(order):
        g = table[:, x[t]] + u @ hs[s]
        gates[s] = g
        i, f, o, c = np.clip(g[:HIDDEN], 0, 1), np.clip(g[HIDDEN : 2 * HIDDEN], 0, 1), np.clip(g[2 * HIDDEN : 3 * HIDDEN], 0, 1), np.clip(g[3 * HIDDEN :], -1, 1)
        raw[s] = cells[s] * f + i * c
        cells[s + 1] = np.clip(raw[s], -1, 1)
        hs[s + 1] = o * cells[s + 1]
    return gates, cells, raw, hs, list(order)


def _layer_back(table: np.ndarray, u: np.ndarray, x: np.ndarray, kept: tuple, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights. ``d_out``: of the hidden states, by time."""
    gates, cells, raw, hs, order = kept
    n = x.shape[1]
    d_u, dz = np.zeros_like(u), np.empty((len(order), 4 * HIDDEN, n))
    dh, dc = np.zeros((HIDDEN, n)), np.zeros((HIDDEN, n))
    for s in range(len(order) - 1, -1, -1):
        g = gates[s]
        i, f, o, c = np.clip(g[:HIDDEN], 0, 1), np.clip(g[HIDDEN : 2 * HIDDEN], 0, 1), np.clip(g[2 * HIDDEN : 3 * HIDDEN], 0, 1), np.clip(g[3 * HIDDEN :], -1, 1)
        dh = dh + d_out[order[s]]
        dc = (dc + dh * o) * (np.abs(raw[s]) < 1)
        d = np.concatenate([dc * c, dc * cells[s], dh * cells[s + 1], dc * i])
        d[: 3 * HIDDEN] *= (g[: 3 * HIDDEN] > -0.05) & (g[: 3 * HIDDEN] < 1.05)
        d[3 * HIDDEN :] *= np.abs(g[3 * HIDDEN :]) < 1.05
        dz[s] = d
        d_u += d @ hs[s].T
        dh, dc = u.T @ d, dc * f
    flat = x[order].ravel()
    hot = np.zeros((flat.size, CLASSES))
    hot[np.arange(flat.size), flat] = 1
    return dz.transpose(1, 0, 2).reshape(4 * HIDDEN, -1) @ hot, d_u


def learn(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 5, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Tagger:
    """A tagger from labelled windows (text, spans): CRF likelihood, gradients through time, Adam steps over shuffled batches."""
    x, y = training_windows(windows, seed)
    rng = np.random.default_rng(seed)
    spread = lambda *s: rng.normal(0, 0.15, s)
    centre = np.repeat([0.5, 0.8, 0.5, 0.0], HIDDEN)[:, None]
    share = np.zeros((CLASSES, GROUP.max() + 1))
    share[np.arange(CLASSES), GROUP] = 1
    params = [spread(4 * HIDDEN, share.shape[1]), spread(4 * HIDDEN, share.shape[1]), np.zeros((4 * HIDDEN, CLASSES)), np.zeros((4 * HIDDEN, CLASSES)), spread(4 * HIDDEN, HIDDEN), spread(4 * HIDDEN, HIDDEN), spread(TAGS, 2 * HIDDEN), np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS), np.zeros(TAGS)]
    params[7][0] = 2.0
    shut = np.zeros((4 * HIDDEN, CLASSES))
    shut[: 3 * HIDDEN, NOTHING] = -1e4
    tables = lambda: [centre + params[d] @ share.T + params[2 + d] + shut for d in range(2)]
    m, v, k = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            xb, yb = np.ascontiguousarray(x[rows].T), y[rows].T
            table = tables()
            kept = [_layer(table[d], params[4 + d], xb, d == 1) for d in range(2)]
            hidden = np.concatenate([kept[0][3][1:], kept[1][3][1:][::-1]], 1)
            e = np.matmul(params[6], hidden) + params[7][:, None]
            _, g_e, g_step, g_first, g_last = _crf(e, yb, params[8], params[9], params[10])
            # each character speaks for itself too, so that insides don't win where no begin can
            alone = np.exp(e - e.max(1, keepdims=True))
            alone /= alone.sum(1, keepdims=True)
            np.put_along_axis(alone, yb[:, None], np.take_along_axis(alone, yb[:, None], 1) - 1, 1)
            g_e += ALONE / len(rows) * alone
            d_hidden = np.matmul(params[6].T, g_e)
            backs = [_layer_back(table[d], params[4 + d], xb, kept[d], d_hidden[:, d * HIDDEN : (d + 1) * HIDDEN]) for d in range(2)]
            own = [np.where(SHARED, 0.0, b[0]) for b in backs]
            grads = [backs[0][0] @ share, backs[1][0] @ share, *own, backs[0][1], backs[1][1], np.einsum("tkn,thn->kh", g_e, hidden), g_e.sum((0, 2)), g_step, g_first, g_last]
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            k += 1
            now = rate * min(1, k / 20) * (1 - 0.95 * k / total)
            for p, g, m_, v_ in zip(params, grads, m, v, strict=True):
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m_ += 0.1 * (g - m_)
                v_ += 0.01 * (g * g - v_)
                p -= now * (m_ / (1 - 0.9**k)) / (np.sqrt(v_ / (1 - 0.99**k)) + 1e-8)
            # no step is dearer than that from none to none: what speaks for a label is in the characters, and text without it is told at once
            np.minimum(params[8], params[8][0, 0], out=params[8])
            np.minimum(params[9], params[9][0], out=params[9])
            np.minimum(params[10], params[10][0], out=params[10])
    f32 = lambda a: np.ascontiguousarray(a, np.float32)
    start = np.where([t == 0 or t % 2 == 1 for t in range(TAGS)], params[9], -1e4)
    step = np.where(_allowed(), params[8], -1e4)
    step[:, 1::2] -= CAUTION
    return Tagger([f32(t) for t in tables()], [f32(params[4]), f32(params[5])], f32(params[6]), f32(params[7]), f32(step), f32(start), f32(params[10]))


# --- Spark


def _cut(text: str, around: int) -> tuple[str, list[tuple[int, int, int]]]:
    a = max(0, around)
    part = text[a : a + FIT_WIDTH]
    return part, [(s - a, k, e - a) for s, k, e in base_spans(text[max(0, a - 200) : a + FIT_WIDTH + 200]) for s, e in [(s + max(0, a - 200), e + max(0, a - 200))] if s >= a and e <= a + FIT_WIDTH]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, windows: int = SAMPLE_WINDOWS) -> Tagger:
    """A tagger from at most ``windows`` windows of at most ``sample`` ids, those with the smallest hashes.

    Of each text: windows around its first matches of the patterns, and two others. Documents without an id aren't learnt
    from. A table without texts gives a tagger that knows the made-up pieces only.
    """
    chosen = durable(docs.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")

    def make() -> Callable:
        def work(piece):
            out = []
            for i, t in zip(piece.column("id").to_pylist(), piece.column("t").to_pylist(), strict=True):
                t, rng = t or "", np.random.default_rng(zlib.crc32(str(i).encode()))
                starts = [a - int(rng.integers(10, FIT_WIDTH // 2)) for a, *_ in base_spans(t)[:3]] + [int(rng.integers(0, max(1, len(t) - FIT_WIDTH))) for _ in range(2)]
                out.append([{"w": w, "s": [x for one in s for x in one]} for w, s in (_cut(t, a) for a in starts) if w])
            return [pa.array(out, pa.list_(pa.struct([("w", pa.string()), ("s", pa.list_(pa.int32()))])))]

        return work

    kind = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("s", T.ArrayType(T.IntegerType()))]))
    found = map_texts(rows, "t", ["id"], make, [T.StructField("ws", kind)]).select("id", F.explode("ws").alias("w")).select("id", "w.w", "w.s").distinct()
    got = found.orderBy(F.xxhash64("id"), "id", "w").limit(windows).collect()  # at most ``windows`` short texts
    return learn([(r["w"], [tuple(r["s"][i : i + 3]) for i in range(0, len(r["s"]), 3)]) for r in got])


def find(docs: DataFrame, tagger: Tagger, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``base`` and ``added``: arrays of (start, end, kind), in code points, end exclusive.

    ``base`` holds the patterns' matches, ``added`` what the tagger finds where they have nothing. Null and empty texts have none; texts of any length are read whole.
    No shuffle; columns named ``base`` and ``added`` are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)  # some KB
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def make() -> Callable:
        mine = shipped.value

        def work(piece):
            found = all_spans(piece.column(text).to_pylist(), mine)
            return [pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in f[n]] for f in found], pa.list_(span)) for n in range(2)]

        return work

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    return map_texts(docs, text, keep or docs.columns, make, [T.StructField("base", kind), T.StructField("added", kind)])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``find`` whose spans are replaced by their kinds, in angle brackets. Where spans overlap, the one that starts first counts."""
    spans = F.sort_array(F.concat("base", "added"))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["done"], cut(s["at"], x["start"]), F.lit("<"), x["kind"], F.lit(">")).alias("done"), x["end"].alias("at")))
    whole = F.aggregate(spans, begin, step, lambda s: F.concat(s["done"], cut(s["at"], F.char_length(F.col(text)).cast("long"))))
    return docs.withColumn(text, whole)
