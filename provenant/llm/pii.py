"""Personal data: base patterns, and a character BiLSTM with CRF transitions.

Base spans come from four fixed patterns. The network finds what these cannot
say: mails that are spaced or spelled (``name (at) host [dot] org``), phones
without a plus or with other separators, cards and addresses in other notations.
It reads overlapping windows of characters, tags them with begin and inside tags
of the four kinds and decodes the best path under learned transitions; of two
overlapping windows each decides the half nearer its middle, and spans that meet
there are joined, so a span is found once whatever windows it crosses. A decoded
span is added unless it meets a base span, or a match that the base check dropped
(a number in the notation of cards that fails it stays dropped); white space at
its ends goes, and no other rule looks at it. Base spans always stay.

What is looked for holds a digit, an ``@`` or a bracketed ``at``, so windows
without one are not read by the network; all windows with one are.

Training takes windows of a bounded sample: of about ``pool`` documents chosen by
hash, ``windows_each`` windows of each, chosen by hash from the whole text (half of
them with a digit or ``@``), at most ``sample`` windows in all. Their labels are the
base spans. Into copies of them labelled spans of both sorts, base and other, are
written, and near misses without a label (dates, amounts, hashes, versions,
numbers that fail the checks), also across the ends of a window; there are
``written`` of them, and a step takes a part of ``crop`` characters of each of its windows.

Defined cases: a null text is empty; an empty text has no span; an empty table
gives no rows; repeated rows are read apiece; a null id is a row like any other;
of spans of two kinds that would meet the path has one; a very long text is read
whole, a slice of its windows at a time; only ``doc_id`` and ``text`` are read, so
no further column can clash. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_hash, texts

KINDS = ("email", "ip", "card", "phone")
#: email is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, matched from its @ outwards
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+): a match can only begin where a run of digits does
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?[aA][tT] ?[)\]}]")
WINDOW, STRIDE, HIDDEN = 96, 48, 20
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Characters that are told apart; of letters only those of "at" and "dot".
_CHARS = {c: i for i, c in enumerate("@._%+-()[]{}/:,;#$&*!?='\"<>|\n\t ", 6)}
_LETTERS = {c: 6 + len(_CHARS) + i for i, c in enumerate("atdo")}
CLASSES = 6 + len(_CHARS) + len(_LETTERS)
_CLASS = np.full(0x250, 4, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _plain = 1 if _s in "0123456789" else 2 if "a" <= _s <= "z" else 3 if "A" <= _s <= "Z" else 4 if _s.isalpha() else 5
    _CLASS[_c] = _CHARS.get(_s, _LETTERS.get(_s.lower(), _plain) if _plain in (2, 3) else _plain)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; failing matches are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            out["email"].append((s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT(text):
        # int() of a part of unbounded length is avoided: more than three figures exceed 255 unless zeros lead
        out["ip"] = [
            m.span() for m in IP.finditer(text)
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))
        ]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def failed_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the base patterns that only the check of their figures dropped:
    the base rules have the last word on their own notations."""
    out = [
        m.span() for m in IP.finditer(text)
        if all(len(x) <= 3 for x in m[0].split(".")) and any(int(x) > 255 for x in m[0].split("."))
    ]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and not luhn(d):
            out.append(m.span())
    return out


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(code, len(_CLASS) - 1)]


def starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a trigger, on a grid of STRIDE."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    at = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64) // STRIDE
    return STRIDE * np.unique(np.clip(np.concatenate([at, at - 1]), 0, last)) if len(at) else at


def cut(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that begin ``at`` these places, filled up with zeros."""
    x = np.zeros((len(at), WINDOW), np.uint8)
    for i, s in enumerate(at):
        part = cls[s : s + WINDOW]
        x[i, : len(part)] = part
    return x


def tags_of(length: int, spans: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for k, kind in reversed(list(enumerate(KINDS))):
        for s, e in spans[kind]:
            tags[s:e] = 2 + 2 * k
            tags[s] = 1 + 2 * k
    return tags


class Tagger:
    """Bidirectional LSTM under a linear-chain CRF; windows run side by side, and so
    do the two directions (the first axis of its arrays)."""

    NAMES = ("wx", "wh", "out", "ob", "trans")

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.wx, self.wh = n(2, CLASSES, 4 * HIDDEN), n(2, HIDDEN, 4 * HIDDEN)
        self.wx[:, :, HIDDEN : 2 * HIDDEN] += 1  # a character's row has the bias in it; forget gates begin open
        self.out, self.ob, self.trans = n(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros(
            (TAGS, TAGS), np.float32
        )

    def _run(self, x: np.ndarray, keep: bool):
        """Hidden states (2, time, windows, HIDDEN), each direction in its own time,
        and what the way back needs."""
        batch, steps = x.shape
        both = np.stack([x.T, x.T[::-1]])
        h = c = np.zeros((2, batch, HIDDEN), self.wx.dtype)
        hs, cache = np.empty((2, steps, batch, HIDDEN), self.wx.dtype), []
        for t in range(steps):
            a = np.matmul(h, self.wh)
            a[0] += self.wx[0][both[0, t]]
            a[1] += self.wx[1][both[1, t]]
            s = 1 / (1 + np.exp(-a[..., : 3 * HIDDEN]))
            g = np.tanh(a[..., 3 * HIDDEN :])
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[:, t] = h
            if keep:
                cache.append((old_h, i, f, o, g, old_c, tc))
        return hs, (both, cache)

    def _back(self, dhs: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray]:
        both, cache = kept
        _, steps, batch, _ = dhs.shape
        da, dwh = np.empty((2, steps, batch, 4 * HIDDEN), dhs.dtype), np.zeros_like(self.wh)
        dh = dc = np.zeros((2, batch, HIDDEN), dhs.dtype)
        back = self.wh.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            old_h, i, f, o, g, old_c, tc = cache[t]
            dh = dh + dhs[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d = da[:, t]
            d[..., :HIDDEN] = dc * g * i * (1 - i)
            d[..., HIDDEN : 2 * HIDDEN] = dc * old_c * f * (1 - f)
            d[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            d[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
            dwh += np.matmul(old_h.transpose(0, 2, 1), d)
            dh, dc = np.matmul(d, back), dc * f
        one = (both.reshape(2, 1, -1) == np.arange(CLASSES)[:, None]).astype(dhs.dtype)
        return np.matmul(one, da.reshape(2, steps * batch, -1)), dwh

    def _emit(self, x: np.ndarray, keep: bool = False):
        hs, kept = self._run(x, keep)
        h = np.concatenate([hs[0], hs[1, ::-1]], 2)
        return h @ self.out + self.ob, h, kept

    def grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the CRF's negative log likelihood, a mean over windows."""
        z, h, kept = self._emit(x, True)
        steps, batch, _ = z.shape
        ez, et = np.exp(z - z.max(2, keepdims=True)), np.exp(self.trans)
        alpha, beta, norm = np.empty_like(ez), np.ones_like(ez), np.empty((steps, batch, 1), ez.dtype)
        a = ez[0]
        for t in range(steps):  # each step is brought to a sum of one
            a = a if not t else (alpha[t - 1] @ et) * ez[t]
            norm[t] = a.sum(1, keepdims=True)
            alpha[t] = a / norm[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (ez[t + 1] * beta[t + 1] / norm[t + 1]) @ et.T
        dz = alpha * beta
        dtrans = et * np.tensordot(alpha[:-1], (ez * beta / norm)[1:], ([0, 1], [0, 1]))
        yt = y.T
        np.subtract.at(dtrans, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        dz[np.arange(steps)[:, None], np.arange(batch), yt] -= 1
        dz, dtrans = dz / batch, dtrans / batch
        dh = dz @ self.out.T
        dwx, dwh = self._back(np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]]), kept)
        return dict(
            zip(self.NAMES, (dwx, dwh, np.tensordot(h, dz, ([0, 1], [0, 1])), dz.sum((0, 1)), dtrans), strict=True)
        )

    def train(self, draw: Callable[[], tuple[np.ndarray, np.ndarray]], steps: int = 1_000, rate: float = 0.03) -> None:
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for t in range(1, steps + 1):
            for k, g in self.grads(*draw()).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                setattr(
                    self, k,
                    (
                        getattr(self, k) - rate * (1 - 0.95 * t / steps) * (m[k] / (1 - 0.9**t)) / (
                            np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6
                        )
                    ).astype(np.float32)
                )

    def decode(self, x: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Best tag paths (Viterbi) of the windows."""
        out = np.empty(x.shape, np.uint8)
        for s in range(0, len(x), chunk):
            z = self._emit(x[s : s + chunk])[0]
            best, back = z[0], []
            for t in range(1, len(z)):
                c = best[:, :, None] + self.trans
                k = c.argmax(1)
                back.append(k)
                best = np.take_along_axis(c, k[:, None], 1)[:, 0] + z[t]
            path = [best.argmax(1)]
            for k in reversed(back):
                path.append(np.take_along_axis(k, path[-1][:, None], 1)[:, 0])
            out[s : s + chunk] = np.stack(path[::-1], 1)
        return out


class Writer:
    """Makes up labelled spans, base and other, and near misses."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, least: int = 2, most: int = 9) -> str:
        return "".join(chr(97 + c) for c in self.rng.integers(0, 26, int(self.rng.integers(least, most + 1))))

    def email(self, base: bool) -> str:
        name = self.word() + self.pick(
            "", "", "." + self.word(), "_" + self.word(), "." + self.digits(2), self.digits(2)
        )
        host = [
            self.word() + self.pick("", "", self.digits(1)), *([self.word()] if self.rng.random() < 0.4 else []),
            self.pick("com", "org", "net", "de", "info", self.word(2, 4))
        ]
        if base:
            return name + "@" + ".".join(host)
        at, dot = self.pick(
            (" @ ", "."), ("@ ", "."), (" @", "."), (" @ ", " . "), (" (at) ", " (dot) "), ("(at)", "(dot)"),
            (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "."), (" [at] ", "."),
            (" {at} ", " {dot} ")
        )
        return name + at + dot.join(host)

    def ip(self, base: bool) -> str:
        parts = [str(x) for x in self.rng.integers(0, 256, 4)]
        return (
            self.pick(".") if base else self.pick(" . ", "[.]", "(.)", " [.] ", "{.}", " [dot] ", "(dot)")
        ).join(parts)

    def card(self, base: bool) -> str:
        """Sixteen to nineteen digits that pass the check."""
        d = self.digits(self.pick(15, 15, 15, 15, 18))
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        sep = self.pick("", " ", "-") if base else self.pick(".", "  ", "/", "_", " - ", "--", ":")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone(self, base: bool) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        cc = self.pick("1", "44", "49", "33", "34", "351")
        if base:
            return "+" + cc + self.pick(
                f" ({a}) {b}-{c}", f" {a} {b} {c}", f"-{a}-{b}-{c}", f"{a}{b}{c}", f".{a}.{b}.{c}", f" {a} {b}{c}"
            )
        return self.pick(
            f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}",
            f"1-{a}-{b}-{c}", f"00{cc} {a} {b} {c}", f"00{cc}-{a}-{b}-{c}", f"+{cc}/{a}/{b}/{c}", f"({a}) {b}/{c}",
            f"+ {cc} ({a}) {b}-{c}", f"+{cc}  {a}  {b}  {c}"
        )

    def miss(self) -> str:
        d, n, w = self.digits, lambda lo, hi: str(int(self.rng.integers(lo, hi))), self.word
        number = self.digits(self.pick(15, 15, 18))
        wrong = number + next(str(k) for k in range(10) if not luhn(number + str(k)))
        hexes = lambda k: "".join("0123456789abcdef"[x] for x in self.rng.integers(0, 16, k))
        return self.pick(
            n(0, 99), n(0, 10_000), d(int(self.rng.integers(4, 16))), d(int(self.rng.integers(20, 26))), wrong, wrong,
            " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)),
            f"{n(1900, 2100)}-{d(2)}-{d(2)}", f"{n(1, 32)}/{n(1, 13)}/{n(1900, 2100)}",
            f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{d(2)}:{d(2)}:{d(2)}",
            f"{n(1900, 2100)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}.{d(3)}Z",
            f"${n(1, 999)},{d(3)}.{d(2)}", f"{n(0, 100)}.{d(2)}%", f"{n(1, 20)}.{n(0, 20)}.{n(0, 20)}",
            f"v{n(1, 20)}.{n(0, 20)}", hexes(40), hexes(32), f'"{hexes(40)}"',
            f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
            f"{w(2, 3).upper()}-{d(4)}-{w(2, 2).upper()}", f"{n(300, 999)}.{n(256, 999)}.{n(0, 999)}.{n(300, 999)}",
            f"{n(1, 9)}, {n(1, 9)}, {n(1, 99)}, {n(1, 99)}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}", f"@{w()}",
            f"{w()} @ {n(1, 99)} {w()}", f"{n(1, 9)} @ {n(1, 99)}",
            f"{n(1900, 2000)}-{n(2000, 2100)}", f"{n(1, 99)} of {n(100, 999)}", f"{d(2)}.{d(4)}, {d(1)}.{d(4)}",
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}-{d(4)}", f"§{n(1, 20)}.{n(1, 20)}.{n(1, 20)}",
            f"{w()} ({w(2, 3)}) {w()}", f"{w()} [{w(2, 3)}] {n(1, 99)}", f"({n(1, 99)})", f"{w()}{d(2)}",
            f"{w()}.{d(2)}", f"+{n(1, 99)}", f"+{n(1, 99)}.{d(1)}%",
        )

    def any(self) -> tuple[str, int | None, bool]:
        """(text, kind, whether the base patterns say it); no kind: a near miss."""
        if self.rng.random() < 0.4:
            return self.miss(), None, False
        k, base = int(self.rng.integers(len(KINDS))), self.rng.random() < 0.2
        out = getattr(self, KINDS[k])(base)
        return (out.upper() if self.rng.random() < 0.08 else out), k, base

    def write(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A window with one to three of these written over it, at the ends too."""
        x, y = x.copy(), y.copy()
        at = int(self.rng.integers(-30, 40))
        for _ in range(int(self.rng.integers(1, 4))):
            what, k, _ = self.any()
            before, after = self.pick(" ", " ", " ", "\n", " (", ": ", ' "', ", ", "|"), self.pick(
                " ", " ", " ", "\n", ")", ". ", ", ", '"', "### ", "!! ", " | ", "? "
            )
            lo, text = at + len(before), before + what + after
            if lo >= WINDOW - 1:
                break
            own, tag = classes(text), np.zeros(len(text), np.uint8)
            if k is not None:
                tag[len(before) : len(before) + len(what)] = 2 + 2 * k
                tag[len(before)] = 1 + 2 * k
            s, e = max(0, -at), min(len(text), WINDOW - at)
            if s < e:
                x[at + s : at + e], y[at + s : at + e] = own[s:e], tag[s:e]
                # a span of the window that is cut through keeps no stump
                for i, step in ((at + s - 1, -1), (at + e, 1)):
                    while 0 <= i < WINDOW and y[i] and not (step == 1 and y[i] % 2 == 1):
                        y[i] = 0
                        x[i] = 2
                        i += step
            at = at + len(text) + int(self.rng.integers(0, 40))
        return x, y


def drawn(text: str, windows_each: int) -> list[tuple[int, bytes, bytes]]:
    """(hash, classes, tags) of the windows of a text that training takes: one half
    with a trigger, as far as there are such, the others from all the rest, each by
    the least hashes."""
    cls = classes(text)
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    code = lambda s: xxhash.xxh64_intdigest(cls[s : s + WINDOW].tobytes(), 8) >> 1
    least = lambda at, n: sorted((code(s), s) for s in at)[:n]
    take = least(starts(text).tolist(), windows_each // 2)
    take = sorted(take + least({*range(0, last * STRIDE + 1, STRIDE)} - {s for _, s in take}, windows_each - len(take)))
    at = np.array([s for _, s in take])
    x, y = cut(cls, at), cut(tags_of(len(text), base_spans(text)), at)
    return [(h, x[i].tobytes(), y[i].tobytes()) for i, (h, _) in enumerate(take)]


def train(
    docs: DataFrame, sample: int = 6_000, windows_each: int = 6, pool: int = 6_000, written: int = 8_000,
    batch: int = 48, crop: int = 64
) -> Tagger | None:
    """Learns from windows of about ``pool`` documents, chosen by hash, so neither the
    search nor what reaches the driver grows with the corpus. None without text."""
    share = int(min(1.0, pool / max(1, docs.count())) * 2**32)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for t in texts(b.column(0), 100) if t for r in drawn(t, windows_each)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                names=["h", "x", "y"]
            )

    part = docs.where(
        order_hash(F.col("doc_id"), seed=9) < share
    ).select("text").mapInArrow(draw, "h long, x binary, y binary")
    # rows of a fixed size; behind the last condition the limit is kept by an executor, not by the driver
    rows = part.orderBy("h", "x").limit(sample).where("h is not null").collect()
    if not rows:
        return None
    x, y = (np.stack([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("x", "y"))
    full = np.flatnonzero(y.any(1))
    # what is written over: a window whose own figures and brackets, if no base span has them, are letters
    signs = np.array([1, *(_CHARS[c] for c in "@()[]{}")])
    ground = np.where(np.isin(x, signs) & (y == 0), 2, x).astype(np.uint8)
    rng, writer = np.random.default_rng(8), Writer(4)
    wx, wy = (
        np.stack(v)
        for v in zip(*(writer.write(ground[i], y[i]) for i in rng.integers(0, len(x), written)), strict=True)
    )

    def step() -> tuple[np.ndarray, np.ndarray]:
        # a text's own figures may be spans that no pattern says: as misses they count little
        plain = rng.integers(0, len(x), batch // 8)
        own = full[rng.integers(0, len(full), batch // 8)] if len(full) else plain[: batch // 8]
        more = rng.integers(0, written, batch - len(plain) - len(own))
        at = int(rng.integers(0, WINDOW - crop + 1))  # a part of each window, so that spans begin and end anywhere
        part = lambda *v: np.concatenate(v)[:, at : at + crop]
        return part(x[plain], ground[own], wx[more]), part(y[plain], y[own], wy[more]).astype(np.int64)

    net = Tagger()
    net.train(step)
    return net


def reconcile(length: int, at: np.ndarray, paths: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a whole text from the paths of its windows: each window decides
    up to the middle of what it shares with its neighbours."""
    edge, tags = (WINDOW - STRIDE) // 2, np.zeros(length, np.uint8)
    for k, s in enumerate(at):
        lo = s if not k or at[k - 1] != s - STRIDE else s + edge
        hi = s + WINDOW if k + 1 == len(at) or at[k + 1] != s + STRIDE else s + STRIDE + edge
        hi = min(hi, length)
        tags[lo:hi] = paths[k, lo - s : hi - s]
    on = np.flatnonzero(tags)
    if not len(on):
        return []
    kind = (tags[on].astype(np.int64) - 1) // 2
    first = np.r_[True, (np.diff(on) != 1) | (np.diff(kind) != 0) | (tags[on[1:]] % 2 == 1)]
    begin = np.flatnonzero(first)
    end = np.r_[begin[1:], len(on)] - 1
    return [(KINDS[kind[s]], int(on[s]), int(on[e]) + 1) for s, e in zip(begin, end, strict=True)]


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def added(
    text: str, base: dict[str, list[tuple[int, int]]], decoded: list[tuple[str, int, int]]
) -> dict[str, list[tuple[int, int]]]:
    """Base spans and the decoded ones that meet neither these nor failed ones."""
    out = {k: list(v) for k, v in base.items()}
    taken = sorted([*(x for v in base.values() for x in v), *(failed_spans(text) if decoded else ())])
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for kind, s, e in decoded:
        while e > s and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        before = bisect_left(begins, e)  # base spans that begin before the end of this one
        if e > s and (not before or reach[before - 1] <= s):
            out[kind].append((s, e))
    return out


def find(docs: DataFrame, *, sample: int = 6_000, net: Tagger | None = None) -> DataFrame:
    """Counts, digest of the base spans and all spans, of every whole text, by a
    network that is given or learned from these texts."""
    net = net or train(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast({k: getattr(net, k) for k in Tagger.NAMES} if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None
        if sent.value:
            tagger = Tagger()
            tagger.__dict__.update(sent.value)
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows: list = []
            held, size = [], 0

            def flush():
                paths = tagger.decode(np.concatenate([x for *_, x in held])) if held and tagger else None
                k = 0
                for i, text, base, at, x in held:
                    decoded = reconcile(len(text), at, paths[k : k + len(x)]) if paths is not None else []
                    k += len(x)
                    joined = _joined(base)
                    rows[i] = (
                        *(len(base[kind]) for kind in KINDS), hashlib.sha256(joined.encode()).hexdigest(),
                        _joined(added(text, base, decoded))
                    )
                held.clear()

            for i, t in enumerate(texts(b.column(1), 100)):
                rows.append((0, 0, 0, 0, nothing, ""))
                if not t or not TRIGGER.search(t):
                    continue
                at = starts(t)
                x = cut(classes(t), at)
                held.append((i, t, base_spans(t), at, x))
                size += len(x)
                if size > 2_000:
                    flush()
                    size = 0
            flush()
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64() if j < 4 else pa.string()) for j, c in enumerate(cols))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS)
