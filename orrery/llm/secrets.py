"""Secret scans: base patterns, and a character convolutional network over every further candidate.

Base findings are the leftmost non-overlapping matches of three patterns and always stay. Candidates are runs
of CANDIDATE or more characters of keys and codes. The network sees each with its context, WIDTH characters in
all (of a longer one overlapping windows, and the largest score counts): characters in or out of the candidate,
one-hot, a convolution, rectifier, maximum and mean over positions, a hidden layer, logistic output.

It is trained, in one task, on labelled findings: values that a base pattern accepts, in their own contexts and in
others; made-up keys of many alphabets, lengths and prefixes; and, as what is no secret, candidates that no
pattern accepts, at less weight, and made-up ids, numbers, names, paths, files, sequences, encoded prose and digests. SAMPLE bounds what is drawn from the
documents, in one scan. A quarter of the values, and of the contexts, is held back: every example of a value
is on one side. The held-back part calibrates the score (slope and offset of the logit) and sets the threshold:
the highest that keeps RECALL of its secrets. A candidate at or above it is a finding of kind `cnn`, if no base
one covers it.

Runs are found for whole batches of bytes at once; positions are code points of the whole text.

Defined results: null text is empty and has no findings; a text holding nothing that could match is skipped
after one scan; repeated rows are scanned alike; where no finding is labelled the made-up values alone train the
network; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.session import released
from orrery.llm.textkit import runs, slices

# The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "cnn")
WORDS = (b"passw", b"secret", b"token", b"api")

SAMPLE = 4_000
CANDIDATE = 16
WIDTH, LEFT = 72, 24
FILTERS, SPAN, HIDDEN, EPOCHS, RATE = 24, 5, 16, 8, 0.006
RECALL = 0.98
MADE_UP = 9_000
#: What no pattern accepts may still be a secret, so it counts for less.
UNLABELLED = 0.05
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"


def _bytes_in(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8)).astype(np.uint8)


HEX = _bytes_in("0123456789abcdef")
CODE = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
CHAR = np.full(256, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    CHAR[ord(_c)] = _i
IS_CODE = np.append([CODE[ord(c)] for c in ALPHABET], 0).astype(bool)


def _long_runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> np.ndarray:
    """(first byte, byte after the last) of each run of a class."""
    first, length, of = runs(data, offsets, kind)
    keep = (of == 1) & (length >= least)
    return np.stack([first[keep], first[keep] + length[keep]], axis=1)


def _lowered(data: np.ndarray) -> bytes:
    return data.tobytes().lower()


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[list, list]]:
    """For each text with anything to report: base findings and candidates, both (kind, start, end) in bytes of the text."""
    found: dict[int, tuple[list, list]] = {}

    def at(position: int) -> tuple[int, int]:
        text = int(np.searchsorted(offsets, position, side="right")) - 1
        return text, int(offsets[text])

    for a, b in _long_runs(data, offsets, HEX, 24):
        text, base = at(a)
        found.setdefault(text, ([], []))[0].append((2, int(a) - base, int(b) - base))
    for a, b in _long_runs(data, offsets, CODE, CANDIDATE):
        text, base = at(a)
        found.setdefault(text, ([], []))[1].append((3, int(a) - base, int(b) - base))
    whole, lower = data.tobytes(), _lowered(data)
    for needle, body in ((b"AKIA", whole), *((w, lower) for w in WORDS)):
        position = body.find(needle)
        while position >= 0:
            text, _ = at(position)
            found.setdefault(text, ([], []))
            position = body.find(needle, int(offsets[text + 1]))
    for text, (base_findings, _) in found.items():
        # latin-1 keeps one character per byte; the patterns and what they match are ASCII.
        body = whole[offsets[text] : offsets[text + 1]].decode("latin-1")
        base_findings += [(0, m.start(), m.end()) for m in ASSIGN.finditer(body) if m.end(1) - m.start(1) >= 6]
        base_findings += [(1, m.start(), m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 20]
        base_findings.sort(key=lambda f: (f[1], f[0]))
    return found


def window(body: bytes, start: int) -> np.ndarray:
    """Character classes of WIDTH bytes around a candidate that starts there."""
    lo = max(0, start - LEFT)
    piece = np.frombuffer(body[lo : start - LEFT + WIDTH], np.uint8)
    out = np.full(WIDTH, len(ALPHABET), np.int64)
    out[lo - start + LEFT : lo - start + LEFT + piece.size] = CHAR[piece]
    return out


def starts(start: int, end: int) -> list[int]:
    """Where windows along a candidate start: one if it holds the candidate, else overlapping ones up to context after its end."""
    return [start] if end - start <= WIDTH - LEFT else list(range(start, end - WIDTH + 2 * LEFT, WIDTH - 2 * LEFT)) + [end - WIDTH + 2 * LEFT]


class Network:
    """A convolution over one-hot characters, maximum and mean over positions, a hidden layer, logistic output, calibrated."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda size, spread: rng.normal(0, spread, size).astype(np.float32)
        self.weights = {
            "kernel": draw((SPAN, 2 * len(IS_CODE), FILTERS), 0.3), "bias": np.zeros(FILTERS, np.float32),
            "mix": draw((2 * FILTERS, HIDDEN), 0.2), "mix_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 0.3), "offset": np.zeros(1, np.float32),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0

    @staticmethod
    def _marked(x: np.ndarray) -> np.ndarray:
        """Classes of characters, other ones for those in the candidate: the run of code around position LEFT."""
        code = IS_CODE[x]
        inside = np.concatenate([np.logical_and.accumulate(code[:, LEFT - 1 :: -1], axis=1)[:, ::-1], np.logical_and.accumulate(code[:, LEFT:], axis=1)], axis=1)
        inside[:, :LEFT] &= code[:, LEFT : LEFT + 1]
        return np.where(inside, x + len(IS_CODE), x)

    def _forward(self, x: np.ndarray) -> tuple:
        w, n = self.weights, WIDTH - SPAN + 1
        maps = w["bias"] + sum(w["kernel"][j][x[:, j : j + n]] for j in range(SPAN))
        np.maximum(maps, 0, out=maps)
        best = maps.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0], maps.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["mix"] + w["mix_bias"], 0)
        return hidden @ w["out"] + w["offset"], hidden, pooled, maps, best

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, WIDTH - SPAN + 1
        logit, hidden, pooled, maps, best = self._forward(x)
        err = (weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)).astype(np.float32)
        to_hidden = err[:, None] * w["out"] * (hidden > 0)
        to_pooled = to_hidden @ w["mix"].T
        through = np.repeat(to_pooled[:, None, FILTERS:] / n, n, axis=1)
        at = np.arange(len(x))[:, None], best, np.arange(FILTERS)[None, :]
        through[at] += to_pooled[:, :FILTERS]
        through = (through * (maps > 0)).reshape(-1, FILTERS)
        kernel = np.zeros_like(w["kernel"])
        for j in range(SPAN):
            of = x[:, j : j + n].ravel()
            order = np.argsort(of, kind="stable")
            chars, first = np.unique(of[order], return_index=True)
            kernel[j][chars] = np.add.reduceat(through[order], first)
        return {"kernel": kernel, "bias": through.sum(axis=0), "mix": pooled.T @ to_hidden, "mix_bias": to_hidden.sum(axis=0), "out": hidden.T @ err, "offset": err.sum(keepdims=True)}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(self._marked(x[i : i + 256]))[0] for i in range(0, len(x), 256)]).astype(float) if len(x) else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, seed: int = 11) -> Network:
        """Steps by the gradient and its running moments over what is not held back, then calibration on the rest."""
        rng, marked, use, step = np.random.default_rng(seed), self._marked(x), np.flatnonzero(~held), 0
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(EPOCHS):
            rng.shuffle(use)
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(use), 64):
                step += 1
                rows = use[i : i + 64]
                for k, g in self._gradient(marked[rows], y[rows], weight[rows]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
        self._calibrate(self.logits(x[held]), y[held], weight[held])
        return self

    def _calibrate(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))
            self.slope -= 0.05 * float((weight * (p - y) * logit).mean())
            self.shift -= 0.05 * float((weight * (p - y)).mean())
        p = 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))
        secrets = np.sort(p[y == 1])
        if secrets.size:
            self.threshold = float(secrets[int((1 - RECALL) * secrets.size)])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, calibration=np.array([self.slope, self.shift, self.threshold]), **self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        out, parts = cls(), np.load(io.BytesIO(data), allow_pickle=False)
        out.slope, out.shift, out.threshold = map(float, parts["calibration"])
        out.weights = {k: parts[k] for k in out.weights}
        return out


def best_scores(network: Network, candidates: Iterable[tuple[bytes, int, int]], n: int) -> np.ndarray:
    """For n candidates (text, start, end): the largest score of a window along each."""
    out, windows = np.zeros(n), ((i, body, s) for i, (body, a, b) in enumerate(candidates) for s in starts(a, b))
    while some := list(islice(windows, 4096)):
        np.maximum.at(out, [i for i, _, _ in some], network.score(np.stack([window(body, s) for _, body, s in some])))
    return out


SECRET, OTHER, CONTEXT = 1, 0, 2


def _examples(texts: DataFrame, sample: int) -> DataFrame:
    """Bytes left of, in and right of labelled candidates, and of places in any text; at most sample / 2 of each kind, those with the smallest hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, offsets in slices(batch.column(1)):
                whole = data.tobytes()
                for text, (base, candidates) in scan(data, offsets).items():
                    body = whole[offsets[text] : offsets[text + 1]]
                    for _, a, b in candidates:
                        label = SECRET if any(s < b and a < e for _, s, e in base) else OTHER
                        rows.append((body[max(0, a - LEFT) : a], body[a : min(b, a + 4 * WIDTH)], body[b : b + LEFT], label))
                for text in range(hi - lo):
                    body = whole[offsets[text] : offsets[text + 1]]
                    blank = body.find(b" ", len(body) // 2)
                    if blank >= 0:
                        rows.append((body[max(0, blank + 1 - LEFT) : blank + 1], b"", body[blank : blank + LEFT], CONTEXT))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.binary()] * 3 + [pa.int32()], strict=True)], names=["before", "body", "after", "label"])

    found = texts.mapInArrow(cut, "before binary, body binary, after binary, label int").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("before", "body", "after"), "body", "before", "after")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample // 2).drop("at")


def _key(rng: np.random.Generator) -> str:
    """A made-up secret."""
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(len(chars), size=n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = (low + up + num, low + up + num, low + num, up + num, up + "234567", low + up + num + "+/", low + up + num + "-_", "0123456789ABCDEF", "0123456789abcdef")[rng.integers(9)]
    n = int(rng.choice([20, 24, 28, 32, 36, 40, 43, 48, 64, 80, 100, 128])) if rng.random() < 0.6 else int(rng.integers(CANDIDATE + 2, 130))
    key = pick(chars, n)
    if "+/" in chars:
        key += "=" * int(rng.integers(3))
    if rng.random() < 0.25:
        key = pick(low, rng.integers(2, 5)) + "_-"[rng.integers(2)] + (pick(low, rng.integers(3, 6)) + "_" if rng.random() < 0.3 else "") + key
    return key


def _no_key(rng: np.random.Generator, words: list[str]) -> str:
    """Something made up that looks like a candidate and is no secret: ids, paths, names, numbers, sequences, files, encoded prose, patterns."""
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(len(chars), size=n))
    some = lambda n: [words[i] for i in rng.integers(len(words), size=n)]
    num, up = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    how = rng.integers(20)
    if how < 3:
        out = "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        return out.upper() if rng.random() < 0.3 else out
    if how == 3:
        return "/".join(some(rng.integers(3, 8))) + ("/" + pick(num, rng.integers(1, 5)) if rng.random() < 0.6 else "")
    if how == 4:
        return "_-"[rng.integers(2)].join([*some(rng.integers(3, 7)), pick(num, rng.integers(1, 4))])
    if how in (5, 8, 9):
        return "".join(w.capitalize() for w in some(rng.integers(3, 7))) + pick(num, rng.integers(0, 3))
    if how == 6:
        return "".join(some(rng.integers(3, 7)))
    if how == 7:
        return "-".join(pick(num, n) for n in rng.integers(2, 9, size=rng.integers(2, 5)))
    if how in (10, 11):
        return pick(num, rng.integers(CANDIDATE, 40) if rng.random() < 0.5 else rng.integers(CANDIDATE, 20))
    if how == 12:
        return "_-"[rng.integers(2)].join([*some(rng.integers(2, 6)), *([pick(num, rng.integers(1, 5))] if rng.random() < 0.4 else [])]).upper()
    if how in (13, 14):  # sequences over few letters, mostly of one case and without digits
        few = "".join(rng.permutation(list(up))[: rng.integers(3, 21)])
        return pick(few if rng.random() < 0.7 else few.lower(), rng.integers(CANDIDATE, 110))
    if how == 15:
        return "/".join([*some(rng.integers(1, 4)), pick(num, 4), pick(num, 2)]) + "/" + some(1)[0].upper()[:4] + "_" + pick(num, rng.integers(3, 9))
    if how in (16, 17):
        return base64.b64encode(" ".join(some(rng.integers(4, 14))).encode()).decode()
    if how == 18:
        return "".join(w + pick(num, 1) for w in some(rng.integers(3, 7)))
    return pick("abcdefghijklmnopqrstuvwxyzABC0123456789-=_", rng.integers(1, 5)) * int(rng.integers(8, 30))


DIGESTS = ("md5 ", "sha1: ", "sha256-", "checksum ", "digest: ", "ETag ", "commit ", "crc ")


def learn(rows: pd.DataFrame) -> Network:
    """A calibrated network from `rows` (before, body, after, label) and from made-up values, which few labelled findings leave to it alone."""
    rows = rows.sort_values(["label", "body", "before", "after"], kind="stable")
    by = {k: list(g[["before", "body", "after"]].itertuples(index=False, name=None)) for k, g in rows.groupby("label")}
    secrets, others, contexts = (by.get(k, []) for k in (SECRET, OTHER, CONTEXT))
    rng = np.random.default_rng(5)
    contexts = [(a, c) for a, _, c in contexts + others] or [(b" ", b" ")]
    words = [w for a, c in contexts for w in re.findall("[A-Za-z]{2,}", (a + b" " + c).decode("latin-1"))] or ["word"]
    spare = rng.permutation(len(contexts)) % 4 == 0
    places = {h: [c for c, s in zip(contexts, spare, strict=True) if s == h] or contexts for h in (False, True)}
    x, y, weight, held = [], [], [], []

    def add(before: bytes, body: bytes, after: bytes, label: int, back: bool, counts: float = 1.0) -> None:
        text = before[-LEFT:] + body + after[:LEFT]
        a, b = len(before[-LEFT:]), len(before[-LEFT:]) + len(body)
        x.append(window(text, int(rng.choice(starts(a, b)))))
        y.append(label)
        weight.append(counts)
        held.append(back)

    def place(back: bool) -> tuple[bytes, bytes]:
        return places[back][rng.integers(len(places[back]))]

    values = sorted({re.split(rb"[=:]", body.rstrip(b"="))[-1] for _, body, _ in secrets})
    back_value = {v: bool(b) for v, b in zip(values, rng.permutation(len(values)) % 4 == 0, strict=True)}
    for before, body, after in secrets:
        value = re.split(rb"[=:]", body.rstrip(b"="))[-1]
        add(before, body, after, 1, back_value[value])
        if len(value) >= CANDIDATE:
            left, right = place(back_value[value])
            add(left, value, right, 1, back_value[value])
    for i, (before, body, after) in enumerate(others):
        add(before, body, after, 0, i % 4 == 0, UNLABELLED)
    for i in range(MADE_UP):
        back = i % 4 == 0
        left, right = place(back)
        add(left, _key(rng).encode(), right, 1, back)
        left, right = place(back)
        if i % 8 == 1:  # a digest, and its name before it
            left, body = left + DIGESTS[rng.integers(len(DIGESTS))].encode(), "".join("0123456789ABCDEF"[k] for k in rng.integers(16, size=rng.choice([32, 40, 64]))).encode()
        else:
            body = _no_key(rng, words).encode()
        add(left, body, right, 0, back)
    return Network().train(np.stack(x), np.array(y, float), np.array(weight), np.array(held))


def train(texts: DataFrame, sample: int = SAMPLE) -> Network:
    """The network that one task learns from a bounded sample of the texts' candidates."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"network": [learn(rows).to_bytes()]})

    found = _examples(texts, sample).withColumn("model", F.lit(0)).groupBy("model").applyInPandas(fit, "network binary").collect()
    return Network.from_bytes(found[0][0]) if found else Network()


def findings(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    shared = texts.sparkSession.sparkContext.broadcast(train(texts))
    nothing = hashlib.sha256(b"").hexdigest()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            n = batch.num_rows
            counts, sha, spans = np.zeros((n, 4), np.int64), [nothing] * n, [""] * n
            for lo, _, data, offsets in slices(batch.column(1)):
                whole, seen = data.tobytes(), scan(data, offsets)
                free = [(t, c) for t, (base, candidates) in seen.items() for c in candidates if not any(s < c[2] and c[1] < e for _, s, e in base)]
                if free:
                    score = best_scores(network, ((whole[offsets[t] : offsets[t + 1]], c[1], c[2]) for t, c in free), len(free))
                    for (t, c), p in zip(free, score, strict=True):
                        if p >= network.threshold:
                            seen[t][0].append(c)
                for t, (kept, _) in seen.items():
                    if kept:
                        body = whole[offsets[t] : offsets[t + 1]]
                        kept.sort(key=lambda f: (f[1], f[0]))
                        named = [(k, f"{KINDS[k]}:{len(body[:s].decode())}:{len(body[:e].decode())}") for k, s, e in kept]
                        spans[lo + t] = ",".join(x for _, x in named)
                        sha[lo + t] = hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest()
                        for k, _ in named:
                            counts[lo + t, k] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(3)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, 3])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"])
        released()

    return texts.mapInArrow(look, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")
