"""Operator 1: secrets in texts, by rules and by a character convolutional network.

Rules find three kinds of findings. Every one of them, and every part that they leave
of a run of at least ``RUN`` token characters, is a candidate: the network reads it
whole, with its surroundings, in overlapping windows of ``WINDOW`` characters, and the
largest window counts. A part that reaches the threshold is a finding of kind ``cnn``;
a rule's finding stays one whatever its score.

The network is trained in numpy on labelled findings: by default a seeded set of
made-up secrets of the forms of ``SECRETS`` and harmless look-alikes in made-up
surroundings, or any rows (before, candidate, after, label) given to fit(). Three parts
of them are kept apart: three fifths train, a fifth calibrates the logits (Platt
scaling), and a fifth sets the threshold: the largest that keeps ``recall`` of its secrets.

A null text is empty. Offsets count code points, ends are exclusive. Ties and
repeated rows are found alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices

# The kinds of findings and their patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "cnn")
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN, BEFORE, AFTER, WINDOW = 16, 24, 12, 96
_SIGN = re.compile("[A-Za-z0-9]")

Span = tuple[int, str, int]
Found = tuple[int, str, int, float]


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """The rules' findings; runs: where ``RUN`` token characters or more stand (hex and access findings lie inside one)."""
    out = []
    raw = text.encode(errors="replace").lower()
    if any(w in raw for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for a, b in runs:
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def char_classes() -> np.ndarray:
    """A class for each code point under 128 and one for the rest: letters and digits apart, each sign its own."""
    out = np.zeros(129, np.int64)
    signs = 64
    for c in range(128):
        if chr(c).isalpha():
            out[c] = 1 + (c & 31) + (27 if c < 96 else 0)
        elif chr(c).isdigit():
            out[c] = 55
        elif c > 32:
            signs += 1
            out[c] = signs - 8
    out[128] = 95
    return out


_CLASS = char_classes()
CLASSES = 96


def encode(before: str, candidate: str, after: str) -> list[np.ndarray]:
    """Windows over one candidate and its surroundings; a class is counted apart inside the candidate. 0: nothing."""
    whole = f"{before}{candidate}{after}"
    x = _CLASS[np.minimum(np.frombuffer(whole.encode("utf-32-le"), np.uint32), 128)] + 1
    x[len(before) : len(before) + len(candidate)] += CLASSES
    out = []
    for a in range(0, max(1, len(x) - AFTER), WINDOW - 32):
        row = np.zeros(WINDOW, np.int64)
        part = x[a : a + WINDOW]
        row[: len(part)] = part
        out.append(row)
    return out


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, a hidden layer, a logit; all of fixed size."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Characters of the shortest candidate: RUN, or those of the shortest labelled secret.
    least: int = RUN

    WIDTH = 5

    @classmethod
    def new(cls, rng: np.random.Generator, dim: int = 12, filters: int = 48) -> Network:
        embed = rng.normal(0, 0.3, (2 * CLASSES + 1, dim)).astype(np.float32)
        embed[0] = 0
        return cls(embed, rng.normal(0, (cls.WIDTH * dim) ** -0.5, (cls.WIDTH * dim, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, filters**-0.5, filters).astype(np.float32), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        e = self.embed[x]
        n, length, dim = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, (self.WIDTH, dim), axis=(1, 2)).reshape(n, length - self.WIDTH + 1, self.WIDTH * dim)
        z = cols @ self.conv + self.conv_bias
        top = z.argmax(axis=1)
        best = np.maximum(np.take_along_axis(z, top[:, None], axis=1)[:, 0], 0)
        return cols, top, best, best @ self.out + self.out_bias

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the logistic loss."""
        cols, top, best, logit = self.forward(x)
        g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        back = g[:, None] * self.out * (best > 0)
        self.out -= rate * (best.T @ g)
        self.out_bias -= rate * float(g.sum())
        chosen = cols[np.arange(len(y))[:, None], top]
        grad_cols = back[:, :, None] * self.conv.T
        self.conv -= rate * np.einsum("nf,nfd->df", back, chosen)
        self.conv_bias -= rate * back.sum(axis=0)
        dim = self.embed.shape[1]
        places = top[:, :, None] + np.arange(self.WIDTH)
        at = np.take_along_axis(x, places.reshape(len(y), -1), axis=1).reshape(-1)
        np.add.at(self.embed, at, -rate * grad_cols.reshape(-1, dim))
        self.embed[0] = 0

    def scores(self, windows: list[list[np.ndarray]]) -> np.ndarray:
        """Calibrated probability of each candidate, from its windows."""
        if not windows:
            return np.zeros(0)
        flat = np.stack([w for ws in windows for w in ws])
        logit = np.concatenate([self.forward(flat[i : i + 512])[3] for i in range(0, len(flat), 512)])
        first = np.cumsum([0, *(len(ws) for ws in windows[:-1])])
        return 1 / (1 + np.exp(-(self.scale * np.maximum.reduceat(logit, first) + self.shift)))


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

ONSETS = "b c d f g h j k l m n p r s t v w z st tr pr ch sh th pl fr br sch qu".split() + [""] * 4
VOWELS = "a e i o u a e i o e ea ou io ie ei y".split()
CODAS = "n r s t l nd ng st m ck tion lich".split() + [""] * 12


class Maker:
    """Seeded strings."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def size(self, a: int, b: int) -> int:
        return int(self.rng.integers(a, b))

    def pick(self, letters: str, least: int, most: int = 0) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), self.size(least, most + 1) if most else least))

    def word(self) -> str:
        """One to four syllables, as words of a language have them."""
        return "".join(ONSETS[self.size(0, len(ONSETS))] + VOWELS[self.size(0, len(VOWELS))] + CODAS[self.size(0, len(CODAS))] for _ in range(self.size(1, 5)))

    def words(self, least: int, most: int = 0, gap: str = " ") -> str:
        return gap.join(self.word() for _ in range(self.size(least, most + 1) if most else least))

    def one_of(self, choices: Sequence) -> object:
        return choices[self.size(0, len(choices))]


_ALL = UPPER + LOWER + DIGITS
#: Forms of secrets, each a function of a Maker.
SECRETS: dict[str, Callable[[Maker], str]] = {
    "prefixed": lambda m: str(m.one_of(("ghp_", "sk_live_", "glpat-", "npm_"))) + m.pick(_ALL, 20, 36),
    "chat": lambda m: "xoxb-" + m.pick(DIGITS, 12) + "-" + m.pick(_ALL, 24),
    "signed": lambda m: "eyJ" + m.pick(_ALL, 17, 40) + "." + m.pick(_ALL + "_-", 30, 90) + "." + m.pick(_ALL + "_-", 43),
    "base64": lambda m: m.pick(_ALL + "+/", 32, 88) + "=" * m.size(0, 3),
    "mixed": lambda m: m.pick(_ALL, 20, 64),
    "letters": lambda m: m.pick(UPPER + LOWER, 24, 64),
    "hex": lambda m: m.pick(DIGITS + "abcdef", 20, 64),
    "access": lambda m: "AKIA" + m.pick(UPPER + DIGITS, 16),
    "capitals": lambda m: m.pick(UPPER + DIGITS, 20, 40),
    "assigned": lambda m: str(m.one_of(("password", "passwd", "Secret", "token", "api_key", "API_KEY"))) + str(m.one_of(("=", " = ", ": ", " : "))) + str(m.one_of(("", "'", '"'))) + m.pick(_ALL + "_.-", 12, 40),
}
#: Forms of harmless look-alikes.
HARMLESS: dict[str, Callable[[Maker], str]] = {
    "version": lambda m: "v" + ".".join(m.pick(DIGITS, 1, 2) for _ in range(3)) + "-" + m.words(3, gap="-"),
    "path": lambda m: m.words(3, 6, gap="/") + m.pick(DIGITS, 2) + "." + m.pick(LOWER, 3),
    "address": lambda m: "www." + m.word() + m.word() + ".com/" + m.word() + "/" + m.pick(DIGITS, 1, 4),
    "host": lambda m: m.words(2, gap=".") + m.pick(DIGITS, 0, 3) + str(m.one_of(("", "-"))) + m.word() + "." + str(m.one_of(("com", "org", "net", "example.com"))),
    "name": lambda m: m.words(4, gap="_") + m.pick(DIGITS, 1),
    "moment": lambda m: m.pick(DIGITS, 4) + "-" + m.pick(DIGITS, 2) + "-" + m.pick(DIGITS, 2) + "T" + m.pick(DIGITS, 2) + "." + m.pick(DIGITS, 6),
    "camel": lambda m: "".join(m.word().capitalize() for _ in range(4)) + m.pick(DIGITS, 0, 1),
    "dashes": lambda m: m.words(5, gap="-") + "-" + m.pick(DIGITS, 1, 4),
    "long": lambda m: "".join(m.words(4, gap="") for _ in range(m.size(1, 3))) + "." + m.pick(DIGITS, 0, 1),
    "loud": lambda m: m.words(4, 6, gap="").upper(),
    "rule": lambda m: "=" * m.size(10, 30) + m.pick(DIGITS, 2) + m.word() + "-" * m.size(3, 20),
    "numbers": lambda m: ".".join(m.pick(DIGITS, 3) for _ in range(4)) + "..." + m.words(2, gap=""),
    "number": lambda m: m.pick(DIGITS, 12, 20),
}
HINTS = ("key: ", "Bearer ", "auth=", "pwd ", "credential ", "Authorization: ", "client_secret_id ")
PLAIN = ("see ", "file ", "in ", "at ", "version ", "page ", "https:")


def labelled_findings(n: int = 6000, seed: int = 11, form: str = "") -> list[tuple[str, str, str, int]]:
    """Made-up findings (before, candidate, after, 1 for a secret), as many of each label; or n secrets of one form."""
    m = Maker(seed)
    out = []
    for i in range(n):
        label = 1 if form else i % 2
        kinds = SECRETS if label else HARMLESS
        near = str(m.one_of(HINTS if label else PLAIN)) if m.rng.random() < 0.4 else ""
        before = m.words(6) + " " + near
        candidate = kinds[form or str(m.one_of(list(kinds)))](m)
        out.append((before[-BEFORE:], candidate, (" " + m.words(4))[:AFTER], label))
    return out


def fit(findings: list[tuple[str, str, str, int]] | None = None, *, recall: float = 0.98, epochs: int = 12, rate: float = 0.4, seed: int = 3) -> Network:
    """Trains on three fifths of the findings, calibrates on a fifth, and sets the threshold on the last fifth."""
    findings = labelled_findings() if findings is None else findings
    rng = np.random.default_rng(seed)
    windows = [encode(a, b, c) for a, b, c, _ in findings]
    y = np.array([f[3] for f in findings], np.float32)
    order = rng.permutation(len(y))
    fifth = len(y) // 5
    scaled, told, train = order[:fifth], order[fifth : 2 * fifth], order[2 * fifth :]
    x = np.stack([w for i in train for w in windows[i]])
    label = np.array([y[i] for i in train for _ in windows[i]], np.float32)
    net = Network.new(rng)
    net.least = max(1, min([RUN, *(len(f[1]) for f in findings if f[3] and not ASSIGN.fullmatch(f[1]))]))
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            net.step(x[at], label[at], rate * (1 - epoch / epochs))
    if fifth:
        p = np.clip(net.scores([windows[i] for i in scaled]), 1e-6, 1 - 1e-6)
        logit, t = np.log(p / (1 - p)), y[scaled]
        a, b = 1.0, 0.0
        for _ in range(300):
            g = 1 / (1 + np.exp(-(a * logit + b))) - t
            a, b = a - 0.05 * float((g * logit).mean()), b - 0.2 * float(g.mean())
        net.scale, net.shift = a, b
        scores = np.sort(net.scores([windows[i] for i in told])[y[told] > 0.5])
        if len(scores):
            net.threshold = float(scores[int((1 - recall) * len(scores))])
    return net


def recall_by_form(net: Network, n: int = 200, seed: int = 23) -> dict[str, float]:
    """The share of n fresh secrets of each form that reach the threshold."""
    found = {}
    for form in SECRETS:
        scores = net.scores([encode(a, b, c) for a, b, c, _ in labelled_findings(n, seed, form)])
        found[form] = float((scores >= net.threshold).mean())
    return found


_networks: dict[int, Network] = {}


def network() -> Network:
    """The default network; fitted once a process."""
    if 0 not in _networks:
        _networks[0] = fit()
    return _networks[0]


def uncovered(runs: list[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of the runs that no span covers; both are sorted by start."""
    at = 0
    for a, b in runs:
        while at < len(spans) and spans[at][0] < b:
            start, _, end = spans[at]
            if start > a:
                yield a, start
            a = max(a, end)
            if end > b:
                break
            at += 1
        if a < b:
            yield a, b


def find(texts: list[str], net: Network) -> list[list[Found]]:
    """All findings of each text as (start, kind, end, score), by start and kind."""
    runs_of = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % net.least)
    asked: list[tuple[int, int, str, int]] = []
    for k, text in enumerate(texts):
        runs = [m.span() for m in runs_of.finditer(text)]
        spans = base_spans(text, [(a, b) for a, b in runs if b - a >= RUN])
        asked += [(k, *s) for s in spans]
        asked += [(k, a, "cnn", b) for a, b in uncovered(runs, spans) if b - a >= net.least and _SIGN.search(text, a, b)]
    windows = [encode(texts[k][max(0, a - BEFORE) : a], texts[k][a:b], texts[k][b : b + AFTER]) for k, a, _, b in asked]
    found: list[list[Found]] = [[] for _ in texts]
    for (k, a, kind, b), p in zip(asked, net.scores(windows).tolist(), strict=True):
        if kind != "cnn" or p >= net.threshold:
            found[k].append((a, kind, b, p))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[1]))) for x in found]


def scan(df: DataFrame, net: Network | None = None, text: str = "text") -> DataFrame:
    """df with ``findings``, a list of (kind, start, end, score); a column of that name is replaced."""
    df = df.drop("findings")
    kind = "array<struct<kind:string,start:int,end:int,score:double>>"
    schema = df.withColumn("findings", F.lit(None).cast(kind)).schema
    sent = df.sparkSession.sparkContext.broadcast(net or network())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = find([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()], sent.value)
            column = pa.array([[{"kind": k, "start": a, "end": b, "score": p} for a, k, b, p in x] for x in found], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "findings"])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """Counts and digests of find() for documents (doc_id, text); n_cnn: the network's own findings, n_likely: the rules' that reach its threshold."""
    net = network()
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = find([x or "" for x in part.column(1).to_pylist()], sent.value)
            told = [[(k, f"{k}:{a}:{b}") for a, k, b, _ in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([sum(k == kind for k, _ in x) for x in told], pa.int64()) for kind in KINDS[:3]),
                    pa.array([hashlib.sha256(",".join(s for k, s in x if k != "cnn").encode()).hexdigest() for x in told]),
                    pa.array([",".join(s for _, s in x) for x in told]),
                    pa.array([sum(k == "cnn" for k, _ in x) for x in told], pa.int64()),
                    pa.array([sum(k != "cnn" and p >= sent.value.threshold for _, k, _, p in x) for x in found], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_likely"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_likely long")


def redact(df: DataFrame, net: Network | None = None) -> DataFrame:
    """df with each finding in ``text`` replaced by [kind]; overlapping findings are one, named by the first. n_chars follows where it exists."""
    sent = df.sparkSession.sparkContext.broadcast(net or network())
    names = df.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def cut(text: str, spans: list[Found]) -> str:
        out, done = [], 0
        for a, kind, b, _ in spans:
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            found = find([x or "" for x in texts], sent.value)
            new = [x if x is None or not s else cut(x, s) for x, s in zip(texts, found, strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(new, pa.string())
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([len(x) if s else n for x, s, n in zip(new, found, old, strict=True)], part.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, df.schema)
