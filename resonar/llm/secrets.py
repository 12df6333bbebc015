"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are the values of all fixed findings, all whole runs of secret-like characters, letters or digits alone
included, and shorter runs behind words that announce a credential. The network sees all of a candidate, however long, and
the characters around it. It is trained in numpy on labelled findings: all that the fixed patterns find in all rows, in
their real surroundings, against all other runs of those rows, and findings of forms that the patterns do not know, made by
rule. Findings are dealt into groups by hash; each group goes on from the same network, and the networks' mean is the next
round's. Scores are calibrated on counts of all findings of rows kept apart, and the threshold is the highest that keeps
the recall asked for.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id, in_chunks

# The patterns that always count as findings, and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
HINTED = re.compile(r"""\b(?:pwd|pass|passphrase|auth|bearer|credentials?|login|key|pin)["']?[\x20:=]{1,3}["']?([A-Za-z0-9+/_=.!@#$%^&*~-]{8,})""", re.I | re.A)
BEFORE, AFTER, WINDOW, WIDTH = 24, 8, 60, 5
EMBED, FILTERS, HIDDEN = 8, 16, 16
RECALL, SEED = 0.98, 31
#: Findings made by rule. One row in APART is kept apart for the threshold.
MADE, APART = 2000, 3
#: Findings that one task learns from, roughly, and the learning rate of each round over all of them.
GROUP, RATES = 16_000, (3e-3, 1e-3)
#: Scores are counted in steps of 1 / STEP from -FAR to FAR, and networks are summed in steps of 1 / FINE.
STEP, FAR, FINE = 256, 40, 1 << 32


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, start of the value) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted."""
    return [x[:3] for x in base_findings(text)]


def _covered(taken: list[tuple[int, int, int]]) -> list[list[int]]:
    """[start, end], sorted, of the stretches that spans cover."""
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for s, _, e in taken):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    return covered


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end), sorted, of all runs that could be secrets and that no span already taken covers whole."""
    covered = _covered(taken)
    runs = {m.span() for m in CANDIDATE.finditer(text)}
    out, k = [], 0
    for s, e in sorted(runs | {m.span(1) for m in HINTED.finditer(text)}):
        while k < len(covered) and covered[k][1] < e:
            k += 1
        if k == len(covered) or covered[k][0] > s:
            out.append((s, e))
    return out


_CODE = np.full(0x110000, 96, np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[10] = 97
N_CODES = 98
_NOTHING = np.zeros(BEFORE, np.uint8)


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Findings:
    """Candidates as places in one array of character codes; 0 stands for no character."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.codes, self.start, self.end = codes, start, end

    def __len__(self):
        return len(self.start)

    @classmethod
    def in_texts(cls, texts: list[str], places: list[list[tuple[int, int]]]) -> Findings:
        parts, start, end, at = [_NOTHING], [], [], BEFORE
        for text, own in zip(texts, places, strict=True):
            if own:
                codes = _codes(text)
                parts += [codes, _NOTHING]
                start += [at + s for s, _ in own]
                end += [at + e for _, e in own]
                at += len(codes) + BEFORE
        return cls(np.concatenate(parts), np.array(start, np.int64), np.array(end, np.int64))

    @classmethod
    def of(cls, found: list[tuple[str, str, str]]) -> Findings:
        """From (before, candidate, after)."""
        return cls.in_texts([b[-BEFORE:] + c + a[:AFTER] for b, c, a in found], [[(len(b[-BEFORE:]), len(b[-BEFORE:]) + len(c))] for b, c, a in found])

    def some(self, which: np.ndarray) -> Findings:
        return Findings(self.codes, self.start[which], self.end[which])

    def context(self) -> np.ndarray:
        around = np.concatenate((self.start[:, None] + np.arange(-BEFORE, 0), self.end[:, None] + np.arange(AFTER)), axis=1)
        return self.codes[around]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidate's number, first place) of each window; candidates are cut into as many as they need."""
        many = (self.end - self.start + WINDOW - 1) // WINDOW
        owner = np.repeat(np.arange(len(self)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return owner, self.start[owner] + WINDOW * nth

    def window_codes(self, owner: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of windows with what is beside them in the candidate, and how many places of each count."""
        size = np.minimum(WINDOW, self.end[owner] - begin)
        at = begin[:, None] + np.arange(-(WIDTH // 2), size.max() + WIDTH // 2)
        inside = (at >= self.start[owner][:, None]) & (at < self.end[owner][:, None])
        return np.where(inside, self.codes[np.where(inside, at, 0)], 0), size


def _im2col(embedded: np.ndarray) -> np.ndarray:
    n = embedded.shape[1] - WIDTH + 1
    return np.concatenate([embedded[:, k : k + n] for k in range(WIDTH)], axis=2)


class CharNetwork:
    """Embedding, one convolution over the candidate (largest and mean answer), one over the context (largest), two dense layers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, (2 / s[0]) ** 0.5, s)
        self.p = {"e": rng.normal(0, 0.3, (N_CODES, EMBED)), "c": init(WIDTH * EMBED, FILTERS), "cb": np.zeros(FILTERS), "x": init(WIDTH * EMBED, FILTERS), "xb": np.zeros(FILTERS), "h": init(3 * FILTERS + 1, HIDDEN), "hb": np.zeros(HIDDEN), "o": init(HIDDEN, 1)[:, 0], "ob": np.zeros(1)}
        self.scale, self.shift = 1.0, 0.0

    def _convolved(self, wins, lens):
        p = self.p
        cols = _im2col(p["e"][wins])
        conv = np.maximum(cols @ p["c"] + p["cb"], 0)
        conv *= (np.arange(conv.shape[1])[None, :] < lens[:, None])[:, :, None]
        return cols, conv

    def _around(self, context):
        cols = _im2col(self.p["e"][context])
        conv = np.maximum(cols @ self.p["x"] + self.p["xb"], 0)
        return cols, conv, conv.max(axis=1)

    def _answer(self, top, mean, near, size):
        p = self.p
        pooled = np.concatenate((top, mean, near, np.log(size)[:, None] / 4), axis=1)
        hidden = np.maximum(pooled @ p["h"] + p["hb"], 0)
        return hidden @ p["o"] + p["ob"][0], pooled, hidden

    def gradient(self, found: Findings, y, weight=None):
        p = self.p
        owner, begin = found.windows()
        wins, lens = found.window_codes(owner, begin)
        context, size = found.context(), found.end - found.start
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        cols, conv = self._convolved(wins, lens)
        most = conv.max(axis=1)
        top, mean = np.maximum.reduceat(most, first), np.add.reduceat(conv.sum(axis=1), first) / size[:, None]
        xcols, xconv, near = self._around(context)
        z, pooled, hidden = self._answer(top, mean, near, size)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        if weight is not None:
            dz *= weight
        g = {"o": hidden.T @ dz, "ob": dz.sum(keepdims=True)}
        dh = dz[:, None] * p["o"] * (hidden > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(axis=0)}
        dp = dh @ p["h"].T
        dtop, dmean, dnear = (dp[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
        dconv = np.broadcast_to((dmean / size[:, None])[owner][:, None, :], conv.shape).copy()
        at = conv.argmax(axis=1)
        lead = (most == top[owner]) * dtop[owner]
        i, f = np.indices(at.shape)
        np.add.at(dconv, (i, at, f), lead)
        dconv *= conv > 0
        de = np.zeros_like(p["e"])
        g |= {"c": np.tensordot(cols, dconv, ((0, 1), (0, 1))), "cb": dconv.sum(axis=(0, 1))}
        self._embed_gradient(de, wins, dconv @ p["c"].T)
        dx = np.zeros_like(xconv)
        at = xconv.argmax(axis=1)
        i, f = np.indices(at.shape)
        dx[i, at, f] = dnear
        dx *= xconv > 0
        g |= {"x": np.tensordot(xcols, dx, ((0, 1), (0, 1))), "xb": dx.sum(axis=(0, 1))}
        self._embed_gradient(de, context, dx @ p["x"].T)
        g["e"] = de
        return g

    @staticmethod
    def _embed_gradient(de, codes, dcols):
        n = dcols.shape[1]
        for k in range(WIDTH):
            flat = codes[:, k : k + n].ravel()
            part = dcols[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED)
            for d in range(EMBED):
                de[:, d] += np.bincount(flat, part[:, d], N_CODES)

    def fit(self, found: Findings, y, epochs: int, seed: int, batch: int = 64, rate: float = 3e-3, weight=None):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, t = np.arange(len(found)), 0
        for _ in range(epochs):
            rng.shuffle(order)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                t += 1
                for name, g in self.gradient(found.some(some), y[some], None if weight is None else weight[some]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, z, y, n):
        """Fits a logistic scale and shift of the raw score; z was scored n times for findings of label y that training has
        not seen."""
        a, b, n = 1.0, 0.0, n / n.sum()
        for _ in range(500):
            d = n * (1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - y)
            a, b = a - 0.05 * ((d * z).sum() + 1e-3 * (a - 1)), b - 0.05 * d.sum()
        self.scale, self.shift = max(a, 1e-3), b

    def raw(self, found: Findings) -> np.ndarray:
        """The network's answer to each candidate. Windows are worked off in bounded slices, those of one size together."""
        n = len(found)
        if not n:
            return np.zeros(0)
        owner, begin = found.windows()
        most, total = np.zeros((len(owner), FILTERS), np.float32), np.zeros((len(owner), FILTERS), np.float32)
        order = np.argsort(np.minimum(WINDOW, found.end[owner] - begin), kind="stable")
        for k in range(0, len(order), 1024):
            w = order[k : k + 1024]
            _, conv = self._convolved(*found.window_codes(owner[w], begin[w]))
            most[w], total[w] = conv.max(axis=1), conv.sum(axis=1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        size = found.end - found.start
        top, mean = np.maximum.reduceat(most, first), np.add.reduceat(total, first) / size[:, None]
        out = np.zeros(n)
        for k in range(0, n, 1024):
            own = np.arange(k, min(n, k + 1024))
            out[own] = self._answer(top[own], mean[own], self._around(found.some(own).context())[2], size[own])[0]
        return out

    def likely(self, z):
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def probability(self, found: Findings) -> np.ndarray:
        return self.likely(self.raw(found))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unflatten(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = values[at : at + size].reshape(self.p[k].shape).copy()
            at += size


def made_findings(n: int, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Labelled findings (before, candidate, after) made from forms of credentials and of ordinary look-alikes, half of each."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(int(rng.integers(a, b))))
    lower, upper, digit = string.ascii_lowercase, string.ascii_uppercase, string.digits
    mixed, b64 = lower + upper + digit, lower + upper + digit + "+/"
    word = lambda: "".join(pick(("re", "th", "an", "er", "on", "ing", "ed", "es", "tion", "da", "mo", "ka", "lu", "sch", "que", "os")) for _ in range(int(rng.integers(2, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    day = lambda: f"{int(rng.integers(1990, 2035))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}"
    secrets = (
        lambda: some(mixed, 20, 48), lambda: some(b64, 24, 90) + pick(("", "=", "==")), lambda: some(upper + digit, 16, 40), lambda: some(lower + digit, 20, 44),
        lambda: pick(("sk", "pk", "ghp", "xoxb", "key", "glpat", "AIza", "npm")) + pick("_-") + some(mixed, 16, 44), lambda: some(mixed, 6, 10) + pick("-_") + some(mixed, 10, 24), lambda: "eyJ" + some(mixed + "-_", 24, 120),
        lambda: some(lower + upper, 24, 44),
    )
    short = lambda: some(mixed, 4, 6) + pick("!@#$%^&*.-") + some(mixed, 2, 4) + pick(digit)
    plain = (
        lambda: f"{word()}-{word()}-{int(rng.integers(1, 9999))}", lambda: f"{day()}T{int(rng.integers(24)):02d}", lambda: f"{word()}{word()}{int(rng.integers(1, 999))}", lambda: f"{word()}/{word()}/{int(rng.integers(1, 99))}/{word()}",
        lambda: f"{word()}_{word()}_v{int(rng.integers(1, 30))}", lambda: f"{pick(('invoice', 'order', 'section', 'chapter', 'figure', 'ticket'))}-{int(rng.integers(2000, 2030))}-{int(rng.integers(1, 99999)):05d}", lambda: f"{word().capitalize()}{word().capitalize()}{int(rng.integers(1, 99))}",
        lambda: pick(("a1", "ab1", "x-1", "0x0", "=-1a")) * int(rng.integers(6, 30)), lambda: f"{int(rng.integers(1, 999))}-{word()}-{int(rng.integers(1, 99))}-{word()}", lambda: f"{word()}{word()}{word()}-{day()}",
        lambda: word() + word() + word(), lambda: (word() + word() + word()).capitalize(), lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}_{word()}_{word()}", lambda: some(digit, 12, 16), lambda: pick("-=_") * int(rng.integers(12, 80)), lambda: (word() + word() + word()).upper(),
    )
    hints = ("key: ", "Bearer ", "auth ", "credential ", "pwd ", "login with ", "key=", "signed ", "private ", "access key ")
    out, y = [], []
    for k in range(n):
        good = k % 2 == 0
        close = rng.random() < 0.12  # a short run behind a hint
        c = (short() if good else word() + pick(("", word()))) if close else pick(secrets)() if good else pick(plain)()
        hint = pick(hints) if close or rng.random() < (0.5 if good else 0.08) else ""
        out.append((f"{prose(3)} {hint}"[-BEFORE:], c, f"{pick((' ', '. ', ', '))}{prose(1)}."[:AFTER]))
        y.append(float(good))
    return out, np.array(y)


def _findings(text: str):
    base = base_findings(text)
    cut = lambda s, e: (text[max(0, s - BEFORE) : s], text[s:e] if e - s <= 2 * half else text[s : s + half] + text[e - half : e], text[e : e + AFTER])
    half = 5 * WINDOW
    for _, _, e, v in base:
        yield *cut(v, e), 1
    spans = [x[:3] for x in base]
    touched = _covered(spans)
    for s, e in candidates(text, spans):
        k = bisect_left(touched, [e]) - 1  # the last stretch that begins before e
        if k >= 0 and touched[k][1] > s:
            continue
        run = text[s:e]
        if not (e - s >= 16 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            yield *cut(s, e), 0


def labelled(text: str) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label) of all findings of a row: values of fixed findings (1), and runs that no fixed
    finding touches (0). Long runs that mix letters and digits have no label: they may be secrets of another form.

    These are what is learnt from, so one of more than 10 * WINDOW characters is its head and tail of half as many each;
    what is scored is always whole."""
    return list(_findings(text))


_FOUND = "before string, candidate string, after string, label int, apart boolean"


def _labelled(batches):
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    names = [c.split()[0] for c in _FOUND.split(", ")]
    rows: list[tuple] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    for batch in batches:
        for text, apart in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in _findings(text or ""):
                rows.append((*x, apart))
                if len(rows) == 8192:
                    yield out()
                    rows.clear()
    yield out()


def labelled_rows(docs: DataFrame) -> DataFrame:
    """before, candidate, after, label, apart of all findings of all rows, each different one once. apart: of a row kept
    apart for the threshold, one in APART by its id."""
    text = F.col("text").cast("string")
    found = docs.select(text.alias("text"), (crc_of_id() % APART == 0).alias("apart")).mapInArrow(_labelled, _FOUND)
    return found.distinct()


def begun(made: int = MADE, epochs: int = 4, seed: int = SEED) -> CharNetwork:
    """The network that findings made by rule lead to, from which all groups go on."""
    form, truth = made_findings(made, seed)
    model = CharNetwork(seed)
    model.fit(Findings.of(form), truth, epochs, seed)
    return model


def taught(model: CharNetwork, rows: list[tuple[str, str, str, int]], rate: float, *, made: int = MADE, epochs: int = 1, seed: int = SEED) -> CharNetwork:
    """The network after one group of findings and the made ones. Ordinary runs of a group weigh no more than made ones."""
    form, truth = made_findings(made, seed)
    rows = sorted(rows)
    label = np.array([float(r[3]) for r in rows])
    plain = max(1, int((label == 0).sum()))
    weight = np.concatenate((np.ones(made), np.where(label == 1, 1.0, min(1.0, made / plain))))
    out = CharNetwork(seed)
    out.unflatten(model.flat())
    out.fit(Findings.of([*form, *(r[:3] for r in rows)]), np.concatenate((truth, label)), epochs, seed + 1, rate=rate, weight=weight)
    return out


def _steps(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * STEP), -FAR * STEP, FAR * STEP).astype(np.int64) + FAR * STEP


def settle(model: CharNetwork, counts: np.ndarray, recall: float = RECALL, *, made: int = MADE, seed: int = SEED) -> float:
    """Calibrates the network and gives the highest threshold that keeps the recall. counts[label, step] is how many
    findings kept apart have a score in a step; made ones kept apart, and those of the table, are half of it each."""
    form, truth = made_findings(made // 2, seed + 1)
    own = _steps(model.raw(Findings.of(form)))
    apart = np.stack([np.bincount(own[truth == k], minlength=counts.shape[1]) for k in (0, 1)])
    z = (np.arange(counts.shape[1]) - FAR * STEP) / STEP
    model.calibrate(np.tile(z + 0.5 / STEP, 2), np.repeat([0.0, 1.0], len(z)), (counts + apart).ravel())
    above = [np.cumsum(c[1][::-1])[::-1] / c[1].sum() for c in (counts, apart) if c[1].any()]
    k = int(np.flatnonzero(np.mean(above, axis=0) >= recall)[-1])
    return float(model.likely(z[k])) if k else 0.0


def _counts() -> np.ndarray:
    return np.zeros((2, 2 * FAR * STEP + 1), np.int64)


def fit(rows: list[tuple[str, str, str, int, bool]], recall: float = RECALL) -> tuple[CharNetwork, float]:
    """The network and threshold that a few findings, as one group, lead to; the last of each says whether it is kept apart."""
    model, counts = begun(), _counts()
    for rate in RATES:
        model = taught(model, [r[:4] for r in rows if not r[4]], rate)
    for label in (0, 1):
        z = model.raw(Findings.of([r[:3] for r in rows if r[4] and r[3] == label]))
        counts[label] = np.bincount(_steps(z), minlength=counts.shape[1])
    return model, settle(model, counts, recall)


def _teach(shared, rate: float):
    """The network of one group, as whole numbers, so that sums do not depend on which task was first."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("before", "candidate", "after", "label")), strict=True))
        flat = np.rint(taught(shared.value, rows, rate).flat() * FINE).astype(np.int64)
        return pa.table({"place": pa.array(np.arange(len(flat), dtype=np.int32)), "value": pa.array(flat)})

    return run


def _score(shared):
    def run(batches):
        counts = _counts()
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                found = Findings.of(list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)))
                np.add.at(counts, (batch.column(3).to_numpy(), _steps(shared.value.raw(found))), 1)
        label, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[label, step])], names=["label", "step", "n"])

    return run


def trained(docs: DataFrame, *, recall: float = RECALL, group: int = GROUP) -> tuple[CharNetwork, float]:
    """The network and threshold for a table of documents, learnt from all of its rows; without findings in it, made ones
    alone are learnt from. What comes to the driver is one network and the counts of scores, whatever the table's size."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    found = scratch.save(labelled_rows(docs), "labelled", "zstd")
    own = found.where("not apart")
    groups = 1 + own.count() // group
    dealt = own.withColumn("deal", F.pmod(F.xxhash64(F.lit(SEED), "before", "candidate", "after"), F.lit(groups)))
    model = begun()
    for rate in RATES:
        shared = spark.sparkContext.broadcast(model)
        parts = dealt.groupBy("deal").applyInArrow(_teach(shared, rate), "place int, value long")
        got = parts.groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("n")).orderBy("place").toArrow()  # one network
        if got.num_rows:
            model.unflatten(got.column("value").to_numpy() / got.column("n").to_numpy() / FINE)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    got = found.where("apart").select("before", "candidate", "after", "label").mapInArrow(_score(shared), "label int, step int, n long")
    got = got.groupBy("label", "step").agg(F.sum("n").alias("n")).toArrow()  # at most the steps of both labels
    counts = _counts()
    counts[got.column("label").to_numpy(), got.column("step").to_numpy()] = got.column("n").to_numpy()
    shared.unpersist()
    scratch.drop(found)
    return model, settle(model, counts, recall)


def scan_texts(texts: list[str], model: CharNetwork, threshold: float) -> list[tuple[list, list, int]]:
    """(base spans, all spans, base findings that the network would find too) of each text; spans are (start, kind's number, end)."""
    out = []
    for lo, hi in in_chunks(texts, 1 << 20):
        base = [base_findings(t) for t in texts[lo:hi]]
        places = [[(v, e) for _, _, e, v in own] + candidates(t, [x[:3] for x in own]) for t, own in zip(texts[lo:hi], base, strict=True)]
        sure = (model.probability(Findings.in_texts(texts[lo:hi], places)) >= threshold).tolist()
        at = 0
        for own, spots in zip(base, places, strict=True):
            n = len(own)
            spans = [x[:3] for x in own]
            every = spans + [(s, 3, e) for (s, e), ok in zip(spots[n:], sure[at + n : at + len(spots)], strict=True) if ok]
            out.append((spans, sorted(every), sum(sure[at : at + n])))
            at += len(spots)
    return out


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(shared):
    def run(batches):
        model, threshold = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                got = scan_texts([t or "" for t in batch.column(1).to_pylist()], model, threshold)
                count = [pa.array([sum(x[1] == kind for x in b) for b, _, _ in got], pa.int64()) for kind in range(3)]
                sha = pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _, _ in got], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *count, sha, pa.array([_written(e) for _, e, _ in got], pa.string()), pa.array([n for _, _, n in got], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return run


def scan(docs: DataFrame, *, recall: float = RECALL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed of each document.

    spans are kind:start:end in code points, by start and then kind (assign, access, hex, model). n_confirmed counts the
    fixed findings that the network alone would find. Null and empty texts have none. Whole texts are scanned; candidates
    of any length are read whole, in bounded slices. Rows with equal or null doc_id stay rows of their own; other columns,
    of any name, are ignored; an empty table gives an empty table. The network learns from all rows of docs, which is read
    twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, recall=recall))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scan(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact_text(text: str, spans) -> str:
    """text with each stretch that spans cover replaced by <SECRET>."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e <= at:
            continue
        if s > at or not out:
            out += [text[at:s], "<SECRET>"]
        at = e
    return "".join([*out, text[at:]])


def _redact(shared, kept: list[str]):
    def run(batches):
        model, threshold = shared.value
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            got = scan_texts([t or "" for t in texts], model, threshold)
            clean = [t if t is None or not every else redact_text(t, every) for t, (_, every, _) in zip(texts, got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else batch.column(j) for j, c in enumerate(kept)], names=kept)

    return run


def redact(docs: DataFrame, *, recall: float = RECALL) -> DataFrame:
    """docs with the secrets in text replaced; all rows, repeated ones too, and all columns, of any name, stay. A null text
    stays null; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, recall=recall))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_redact(shared, docs.columns), kinds)
