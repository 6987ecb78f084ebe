"""A character BiLSTM with CRF transitions, trained by numpy from labelled spans.

Every character of a text is read. Windows overlap; a character takes its emissions from the
window it is most central in, and one CRF path over the whole text reconciles them. The path is
found exactly in pieces: where the emission of "no span" leads by more than any transitions to
and from another tag could make up, each best path has "no span", so only the stretches between
such places are decoded, all at once, with "no span" on either side.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
N_TAGS = 1 + 2 * len(KINDS)
MARKS = " \n@._%+-()[]{}<>,:;/\\\"'=#*"
PAD, UPPER, DIGIT, FOREIGN, OTHER = 0, 1, 2, 3, 4
_ASCII = np.full(128, OTHER, np.uint8)
for _i, _c in enumerate(MARKS):
    _ASCII[ord(_c)] = 5 + _i
for _i, _c in enumerate(string.ascii_lowercase):
    _ASCII[ord(_c)] = 5 + len(MARKS) + _i
for _c in string.ascii_uppercase:
    _ASCII[ord(_c)] = UPPER
for _c in string.digits:
    _ASCII[ord(_c)] = DIGIT
N_CLASSES = 5 + len(MARKS) + 26
HIDDEN = 12
#: Characters of a training window.
WINDOW = 128
#: Characters of a window when texts are read, and those of it on either side that a neighbour reads better.
SPAN, CONTEXT = 384, 24
#: By how much a place's tag shall lead, and the bound of transitions: both let "no span" be sure at most places of prose.
MARGIN, MOST_TRANSITION = 3.0, 2.0
#: Windows read at once at most, and places of stretches decoded at once.
BATCH, PLACES = 1024, 1 << 16


def classes(text: str) -> np.ndarray:
    """Input class of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < 128, _ASCII[np.minimum(code, 127)], FOREIGN).astype(np.uint8)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table, wh, ids):
    """States (T, B, HIDDEN) of one direction over ids (B, T); also what the backward pass needs."""
    b, t = ids.shape
    h, c = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
    out, kept = np.zeros((t, b, HIDDEN)), []
    for s in range(t):
        z = table[ids[:, s]] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = out[s] = o * tc
        kept.append((gates, g, before, tc, last))
    return out, kept


def _lstm_back(wh, ids, kept, d_out):
    b, t = ids.shape
    d_wh, all_dz = np.zeros_like(wh), np.zeros((t, b, 4 * HIDDEN))
    dh, dc = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
    for s in range(t - 1, -1, -1):
        gates, g, before, tc, last = kept[s]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        dh = dh + d_out[s]
        dc = dc + dh * o * (1 - tc * tc)
        dz = all_dz[s]
        dz[:, :HIDDEN], dz[:, HIDDEN : 2 * HIDDEN], dz[:, 2 * HIDDEN : 3 * HIDDEN] = dc * g, dc * before, dh * tc
        dz[:, : 3 * HIDDEN] *= gates * (1 - gates)
        dz[:, 3 * HIDDEN :] = dc * i * (1 - g * g)
        d_wh += last.T @ dz
        dh, dc = dz @ wh.T, dc * f
    seen = np.zeros((t * b, N_CLASSES))
    seen[np.arange(t * b), ids.T.ravel()] = 1
    return seen.T @ all_dz.reshape(t * b, -1), d_wh


class Tagger:
    """Parameters, the likelihood with its gradients, and the decoding of whole windows in double precision."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 0.25, s)
        p = {"tf": n(N_CLASSES, 4 * HIDDEN), "wf": n(HIDDEN, 4 * HIDDEN), "tb": n(N_CLASSES, 4 * HIDDEN), "wb": n(HIDDEN, 4 * HIDDEN), "wo": n(2 * HIDDEN, N_TAGS), "bo": np.zeros(N_TAGS), "tr": np.zeros((N_TAGS, N_TAGS))}
        return cls(p)

    def emissions(self, ids):
        """(T, B, tags), and the rest for the backward pass."""
        f, kf = _lstm(self.p["tf"], self.p["wf"], ids)
        r = ids[:, ::-1]
        b, kb = _lstm(self.p["tb"], self.p["wb"], r)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["wo"] + self.p["bo"], (h, kf, kb, r)

    def loss(self, ids, tags):
        """Mean negative log-likelihood of a window and its gradients; wrong tags are given MARGIN first (softmax-margin)."""
        n, t = ids.shape
        em, (h, kf, kb, r) = self.emissions(ids)
        em = em + MARGIN
        np.put_along_axis(em, tags.T[:, :, None], np.take_along_axis(em, tags.T[:, :, None], 2) - MARGIN, 2)
        tr, y = self.p["tr"], tags.T
        rows = np.arange(n)
        gold = sum(em[s, rows, y[s]] for s in range(t)) + tr[y[:-1], y[1:]].sum(0)
        # forward and backward sums, scaled to 1 at each place
        top = em.max(2, keepdims=True)
        like, step = np.exp(em - top), np.exp(tr)
        alpha, beta, scale = np.zeros_like(em), np.ones_like(em), np.zeros((t, n))
        for s in range(t):
            x = like[s] if s == 0 else (alpha[s - 1] @ step) * like[s]
            scale[s] = x.sum(1)
            alpha[s] = x / scale[s][:, None]
        z = np.log(scale).sum(0) + top.sum((0, 2))
        d_tr = np.zeros_like(tr)
        for s in range(t - 1, 0, -1):
            x = like[s] * beta[s] / scale[s][:, None]
            d_tr += step * (alpha[s - 1].T @ x)
            beta[s - 1] = x @ step.T
        np.subtract.at(d_tr, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_em = alpha * beta
        np.put_along_axis(d_em, y[:, :, None], np.take_along_axis(d_em, y[:, :, None], 2) - 1, 2)
        d_em /= n
        d_h = d_em @ self.p["wo"].T
        d_tf, d_wf = _lstm_back(self.p["wf"], ids, kf, d_h[:, :, :HIDDEN])
        d_tb, d_wb = _lstm_back(self.p["wb"], r, kb, d_h[::-1, :, HIDDEN:])
        grads = {"tf": d_tf, "wf": d_wf, "tb": d_tb, "wb": d_wb, "wo": np.tensordot(h, d_em, ([0, 1], [0, 1])), "bo": d_em.sum((0, 1)), "tr": d_tr / n}
        return float((z - gold).mean()), grads

    def decode(self, ids):
        """The best tags (B, T) under the CRF."""
        em, _ = self.emissions(ids)
        t, n, _ = em.shape
        best, back = em[0], np.zeros(em.shape, np.int8)
        for s in range(1, t):
            x = best[:, :, None] + self.p["tr"]
            back[s] = x.argmax(1)
            best = em[s] + x.max(1)
        out = np.zeros((n, t), np.int8)
        out[:, -1] = best.argmax(1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[s, np.arange(n), out[:, s]]
        return out

    def reader(self) -> Reader:
        return Reader(self.p)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag sequence; an I without its kind before it opens a span."""
    out, open_ = [], None
    for i, t in enumerate(tags.tolist()):
        kind = (t - 1) // 2 if t else -1
        if open_ and (kind != open_[0] or t % 2 == 1):
            out.append((*open_, i))
            open_ = None
        if t and not open_:
            open_ = (kind, i)
    if open_:
        out.append((*open_, len(tags)))
    return out


#: 1 + x + x^2/2 + x^3/6 = ((x + CUBE_SHIFT)^2 + CUBE_SQUARE) (x + CUBE_ROOT) CUBE_SCALE^3.
CUBE_ROOT = 1.5960716379833215
CUBE_SHIFT = (3 - CUBE_ROOT) / 2
CUBE_SQUARE = 6 / CUBE_ROOT - CUBE_SHIFT**2
CUBE_SCALE = 6 ** (-1 / 3)


class Reader:
    """Reads whole texts with single-precision copies of a tagger's parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        f = lambda x: np.ascontiguousarray(x, np.float32)
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2x)) - 1; gates in the order i, f, o, g, of both sides
        turn = np.array([-1.0, -1.0, -1.0, -2.0])[:, None, None]
        gates = lambda *names: np.stack([turn * p[x].reshape(-1, 4, HIDDEN).transpose(1, 0, 2) for x in names], 1)
        tables, inner = gates("tf", "tb"), gates("wf", "wb")
        most = (np.abs(tables).max(2) + np.abs(inner).sum(2)).max()
        #: exp(x) is taken as the 2^halvings-th power of the cubic at x / 2^halvings, which holds for |x| up to twice that power.
        self.halvings = max(6, int(np.ceil(np.log2(most / 2))))
        scale = CUBE_SCALE / 2**self.halvings
        self.tables = f((tables * scale + CUBE_SCALE * CUBE_SHIFT).reshape(-1, HIDDEN))
        self.inner = f(inner * scale)
        self.out = f(p["wo"][:HIDDEN].T), f(p["wo"][HIDDEN:].T), f(p["bo"][:, None])
        self.tr = f(p["tr"])
        others = range(1, N_TAGS)
        #: What transitions can make up for at most, by tag.
        self.most = f([(self.tr[:, k] - self.tr[:, 0]).max() + (self.tr[k] - self.tr[0]).max() + 1e-3 for k in others])

    def states(self, ids: np.ndarray) -> np.ndarray:
        """(2, T, B, HIDDEN) over ids (2, T, B), read by the forward and by the backward side."""
        _, t, b = ids.shape
        out = np.empty((2, t, b, HIDDEN), np.float32)
        h, c, x = (np.zeros((2, b, HIDDEN), np.float32) for _ in range(3))
        z, y = np.empty((4, 2, b, HIDDEN), np.float32), np.empty((4, 2, b, HIDDEN), np.float32)
        rows, first = np.empty((4, 2, b), np.intp), N_CLASSES * np.arange(8).reshape(4, 2, 1)
        i, f, o, g = z
        # numbers as arrays, which calls don't have to convert
        square, plus, one, two, four = (np.array(v, np.float32) for v in (CUBE_SCALE**2 * CUBE_SQUARE, CUBE_SCALE * (CUBE_ROOT - CUBE_SHIFT), 1, 2, 4))
        with np.errstate(over="ignore"):  # an infinite exponential is a closed gate
            for s in range(t):
                np.add(ids[:, s], first, out=rows)
                np.take(self.tables, rows, axis=0, out=z, mode="clip")
                np.matmul(h, self.inner, out=y)
                z += y
                np.multiply(z, z, out=y)
                y += square
                z += plus
                z *= y
                for _ in range(self.halvings):
                    np.multiply(z, z, out=z)
                z += one
                # c is the cell times -2
                c /= f
                np.divide(four, g, out=g)
                g -= two
                g /= i
                c -= g
                np.exp(c, out=x)
                x += one
                np.divide(two, x, out=x)
                x -= one
                h = out[:, s]
                np.divide(x, o, out=h)
        return out

    def _emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(tags, T, B) over ids (T, B); a column counts up to its length."""
        t, b = ids.shape
        whole = (lengths == t).all()
        cell = np.maximum(lengths - 1 - np.arange(t)[:, None], 0), np.arange(b)
        f, r = self.states(np.stack([ids, ids[::-1] if whole else ids[cell]]))
        em = (self.out[0] @ f.reshape(-1, HIDDEN).T).reshape(N_TAGS, t, b)
        r = (self.out[1] @ (r if whole else r[cell]).reshape(-1, HIDDEN).T).reshape(N_TAGS, t, b)
        em += r[:, ::-1] if whole else r
        em += self.out[2][:, :, None]
        return em

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, tags, B) over ids (T, B); a column counts up to its length."""
        return self._emissions(ids, lengths).transpose(1, 0, 2)

    def unsure(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places where "no span" isn't sure, ascending, and their emissions. A sequence's places come one after the last one's end."""
        size = np.array([len(x) for x in seqs], np.int64)
        first = np.cumsum(size + 1) - size - 1
        jobs = []
        for k, n in enumerate(size.tolist()):
            starts = [0] if n <= SPAN else [*range(0, n - SPAN, SPAN - 2 * CONTEXT), n - SPAN]
            for j, a in enumerate(starts):
                lo = 0 if j == 0 else (starts[j - 1] + SPAN + a) // 2
                hi = n if j == len(starts) - 1 else (a + SPAN + starts[j + 1]) // 2
                jobs.append((min(n, SPAN), k, a, lo - a, hi - a))
        jobs.sort()
        places, values = [], []
        jobs = [j for j in jobs if j[0]]
        groups = -(-len(jobs) // BATCH)
        for at in range(groups):
            part = jobs[at * len(jobs) // groups : (at + 1) * len(jobs) // groups]
            n, k, a, lo, hi = (np.array(x) for x in zip(*part))
            rows = np.zeros((len(part), int(n.max())), np.uint8)
            for i, (m, q, start, _, _) in enumerate(part):
                rows[i, :m] = seqs[q][start : start + m]
            ids = np.ascontiguousarray(rows.T)
            em = self._emissions(ids, n)
            sure = np.ones(ids.shape, bool)
            for other, most in zip(em[1:], self.most):
                sure &= em[0] - other > most
            t = np.arange(len(ids))[:, None]
            t, col = np.nonzero(~sure & (t >= lo) & (t < hi))
            places.append(first[k[col]] + a[col] + t)
            values.append(em[:, t, col].T)
        if not places:
            return np.zeros(0, np.int64), np.zeros((0, N_TAGS), np.float32)
        place, value = np.concatenate(places), np.concatenate(values)
        order = np.argsort(place)
        return place[order], value[order]

    def spans(self, seqs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of each sequence of classes, by the best path over the whole sequence."""
        size = np.array([len(x) for x in seqs], np.int64)
        stop = np.cumsum(size + 1) - 1
        place, em = self.unsure(seqs)
        out: list[list] = [[] for _ in seqs]
        if not len(place):
            return out
        cuts = np.flatnonzero(np.diff(place) > 1) + 1
        begin, end = np.r_[0, cuts], np.r_[cuts, len(place)]
        seq = np.searchsorted(stop, place[begin], "right")
        first = stop[seq] - size[seq]
        free, closed = place[begin] == first, place[end - 1] + 1 == stop[seq]  # at a text's start and end nothing stands beside
        length = end - begin
        order = np.argsort(length, kind="stable")
        found, at = [], 0
        while at < len(order):
            # short stretches come first, many at once
            more = int(np.searchsorted(np.arange(1, len(order) - at + 1) * length[order[at:]], PLACES, "right"))
            pick = order[at : at + max(more, 1)]
            at += len(pick)
            t = int(length[pick[-1]])
            rows = np.minimum(begin[pick][:, None] + np.arange(t), end[pick][:, None] - 1)
            tags = self.path(em[rows], length[pick], free[pick], closed[pick])
            for i in np.flatnonzero(tags.any(1)).tolist():
                s = int(pick[i])
                base = int(place[begin[s]] - first[s])
                found += [(int(seq[s]), base + x, base + y, kind) for kind, x, y in spans_of(tags[i, : length[s]])]
        for k, x, y, kind in sorted(found):
            out[k].append((kind, x, y))
        return out

    def path(self, em: np.ndarray, length: np.ndarray, free: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Best tags (B, T) of stretches (B, T, tags) between places without a span; length ascending."""
        n, t, _ = em.shape
        best = np.empty((t, n, N_TAGS), np.float32)
        best[0] = em[:, 0] + np.where(free[:, None], 0, self.tr[0])
        start = np.searchsorted(length, np.arange(t), "right")  # of the stretches that reach each place
        for s in range(1, t):
            k = start[s]
            before = best[s - 1, k:]
            best[s, k:] = (before.T[:, :, None] + self.tr[:, None, :]).max(0)
            best[s, k:] += em[k:, s]
        rows = np.arange(n)
        now = (best[length - 1, rows] + np.where(closed[:, None], 0, self.tr[:, 0])).argmax(1)
        out = np.zeros((n, t), np.int8)
        out[rows, length - 1] = now
        for s in range(t - 1, 0, -1):
            k = start[s]
            now[k:] = (best[s - 1, k:] + self.tr[:, now[k:]].T).argmax(1)
            out[k:, s - 1] = now[k:]
        return out


# Labelled spans -------------------------------------------------------------------------------


ONSETS = ["", "", *"bcdfghjklmnpqrstvwz", "th", "sh", "ch", "st", "tr", "pr", "gr", "bl", "sch", "qu", "ñ", "ç"]
NUCLEI = [*"aaeeeiioou", "ea", "ou", "ie", "ei", "au", "é", "è", "ü", "ö", "ó", "í"]
CODAS = ["", "", "", *"nrstlmdx", "ng", "nd", "nt", "st", "ch", "tz", "ll", "ß", "sh", "tion", "ly", "ment", "ung", "ción"]
LITTLE = "the of and to in is a that for it was on are with as at by from der die und das nicht ein zu den von les des est que un une dans pour la le et el los y para en con del por se mail call phone card number address dot server host".split()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _word(r) -> str:
    if r.random() < 0.3:
        return r.choice(LITTLE)
    return "".join(r.choice(ONSETS) + r.choice(NUCLEI) + r.choice(CODAS) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _prose(r, n: int) -> str:
    """n words with capitals, marks and line ends."""
    out, start = [], r.random() < 0.3
    for _ in range(n):
        w = _word(r)
        out.append(w.capitalize() if start or r.random() < 0.03 else w)
        mark = r.random()
        start = mark < 0.08
        out.append(r.choice((". ", ".\n", "? ", "! ", ".")) if start else r.choice((", ", ": ", "; ", "\n", " - ", "\n\n", "&&& ", " | ", "* ", "... ", ") ", " (", "/", "_", "' ", "=", "@")) if mark < 0.16 else " ")
    return "".join(out)


def _digits(r, n):
    return "".join(r.choices(DIGITS, k=n))


def luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def _card(r):
    head = (r.choice(("4", "51", "37", "6011", "")) + _digits(r, 15))[:15]
    return next(head + str(k) for k in range(10) if luhn(head + str(k)))


def _low(r, a: int, b: int) -> str:
    """A name of a to b letters."""
    if r.random() < 0.4:
        return "".join(r.choices(LETTERS, k=r.randint(a, b)))
    plain = [x for x in ("".join(c for c in _word(r) if c in LETTERS)[:b] for _ in range(4)) if len(x) >= a]
    return plain[0] if plain else "".join(r.choices(LETTERS, k=a))


def _personal(r, kind):
    if kind == "email":
        user = _low(r, 2, 9) + r.choice(("", "", "." + _digits(r, 2), "_" + _low(r, 3, 6), "." + _low(r, 3, 8), "-" + _low(r, 2, 5), "+" + _low(r, 2, 5), _digits(r, 2)))
        at, dot = r.choice((("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", "."), (" (at) ", "."), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" @ ", ".")))
        host = _low(r, 3, 9) + r.choice(("", "", str(r.randrange(10)), "-" + _low(r, 2, 5)))
        return user + at + dot.join([host, *([_low(r, 2, 5)] if r.random() < 0.2 else []), r.choice(("com", "org", "net", "fr", "de", "es", "io", "edu", "example", "info"))])
    if kind == "ip":
        return r.choice((".", ".", "[.]", "(.)", " . ", "[dot]", " dot ")).join(str(r.randrange(r.choice((10, 100, 256)))) for _ in range(4))
    if kind == "card":
        c, d = _card(r), r.choice(("", "", " ", "-", ".", "/", "_"))
        return d.join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    two = _digits(r, 2)
    return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"00{two} {b} {a}{b}", f"+{two} {a} {b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{two} {two} {c} {c}", f"0{a[:2]} {c} {c}", f"0{a[:2]}/{b}{c}"))


def _plain(r):
    hexa = "".join(r.choices("0123456789abcdef", k=r.randint(12, 40)))
    return r.choice((
        f'token = "{hexa}"', f"password={hexa[:12]}", f"AKIA{hexa[:16].upper()}", _digits(r, r.randint(1, 9)), f"{r.randrange(1900, 2030)}-0{r.randrange(1, 10)}-{r.randrange(10, 29)}",
        f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)}", f"${r.randrange(1, 999)}.{_digits(r, 2)}", f"{r.randrange(24)}:{_digits(r, 2)}", f"@{_low(r, 3, 8)}", f"{_digits(r, 3)},{_digits(r, 3)},{_digits(r, 3)}",
        f"({r.randrange(1, 99)})", "(at)", f"{r.randrange(100)}%", f"{_word(r)} at {_word(r)}", f"the dot {_word(r)}", f"{_low(r, 3, 8)}.{_low(r, 3, 8)}", f"www.{_low(r, 3, 8)}.com", f"https://{_low(r, 3, 8)}.org/{_low(r, 2, 8)}", f"CC BY-{r.randrange(9)}.0", f"{r.randrange(9)}.{r.randrange(99)}",
    ))


def labelled(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows (classes) with the tags of their spans; half of them are plain prose."""
    r = random.Random(seed)
    ids, tags = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, marks, rich = _prose(r, r.randrange(1, 9)), [], r.random() < 0.5
        while len(text) < WINDOW + 60:
            x = r.random()
            if rich and x < 0.45:
                kind = r.randrange(4)
                s = _personal(r, KINDS[kind])
                text += r.choice((" ", " ", "\n", ": ", "(", ' "', "="))
                marks.append((kind, len(text), len(text) + len(s)))
                text += s + r.choice((" ", ". ", ", ", "\n", ") ", '" ', "; "))
            elif x < 0.6:
                text += " " + _plain(r) + " "
            text += _prose(r, r.randrange(1, 8))
        cut = r.randrange(len(text) - WINDOW + 1) if r.random() < 0.6 else 0
        ids[k] = classes(text[cut : cut + WINDOW])
        for kind, a, b in marks:
            a, b = max(a - cut, 0), min(b - cut, WINDOW)
            if a < b:
                tags[k, a:b] = 2 + 2 * kind
                tags[k, a] = 1 + 2 * kind
    return ids, tags


@lru_cache(maxsize=2)
def trained(seed: int = 11, windows: int = 9600, epochs: int = 4, batch: int = 32, rate: float = 0.03) -> Tagger:
    """A tagger fitted by Adam to generated labelled spans."""
    ids, tags = labelled(seed, windows)
    model = Tagger.fresh(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    order_of, step, total = np.random.default_rng(seed), 0, epochs * (windows // batch)
    for _ in range(epochs):
        order = order_of.permutation(windows)
        for b in range(0, windows - batch + 1, batch):
            step += 1
            pick = order[b : b + batch]
            _, g = model.loss(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            now = rate * (1 - 0.9 * step / total)
            for k in model.p:
                x = g[k] * scale
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.999 * s[k] + 0.001 * x * x
                model.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            np.clip(model.p["tr"], -MOST_TRANSITION, MOST_TRANSITION, out=model.p["tr"])
    return model
