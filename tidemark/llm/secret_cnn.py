"""Operator 3: secrets in whole texts, by fixed patterns and a character convolutional network.

Three plain patterns (assignments, access keys, hexadecimal runs) give the base spans; these always stay. Every further
run of twelve and more credential characters with a letter, long words among them, and the base findings too, is a
candidate: the network reads its characters with those
around it (convolution, rectifier, maximum and mean over all positions of the value, one hidden layer). It is trained on
labelled findings: credentials of known formats, planted at word boundaries of sampled documents (label 1), against
harmless identifiers planted alike and candidates that the documents hold themselves outside base findings (label 0).
Half of the findings fit the network, the other half its calibration (a logistic curve) and its threshold: the largest
that keeps ``recall`` of the calibration secrets, wherever on the calibrated scale that lies. ``Network.recall`` and
``Network.false_share`` say what it reaches there.

The sample is bounded (``sample_rows`` documents, the smallest hashes of ids); every document is scanned whole, in one
pass without a shuffle. Spans are in code points, end exclusive.

Defined results. Null text: as empty, no spans. Empty table: no rows (the network is then fitted on findings without
context). Null ids and repeated rows: one result row per row. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import texts as T

KINDS = ("assign", "access", "hex", "network")
Span = tuple[int, int, str]

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: A candidate: twelve credential characters or more, with a letter (checked after the match).
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_HAS_LETTER = re.compile(r"[A-Za-z]")

BEFORE, AFTER = 24, 8
_CODE = np.zeros(128, np.int64)
_CODE[32:127] = np.arange(1, 96)
CHARS, DIM, WIDTH, FILTERS, HIDDEN = 96, 10, 5, 24, 16


def base_spans(text: str) -> list[Span]:
    """The plain patterns' findings, by start and kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def further_candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters that do not meet a base finding."""
    out = []
    for m in _RUN.finditer(text):
        if _HAS_LETTER.search(m[0]) and not any(s < m.end() and e > m.start() for s, e, _ in base):
            out.append(m.span())
    return out


def encoded(text: str, start: int, end: int) -> tuple[np.ndarray, int, int]:
    """Character codes of a candidate with its surroundings, and where its value lies among them."""
    left = max(0, start - BEFORE)
    codes = np.array([ord(c) for c in text[left:end + AFTER]], np.int64)
    codes = np.where(codes < 127, _CODE[np.minimum(codes, 127)], 0)
    pad = BEFORE - (start - left)
    return np.concatenate([np.zeros(pad, np.int64), codes]), BEFORE, BEFORE + end - start


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0
    false_share: float = 0.0

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.kernel_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def fresh(seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    inner = WIDTH * (DIM + 1)
    return Network(rng.normal(0, 0.3, (CHARS, DIM)), rng.normal(0, inner**-0.5, (inner, FILTERS)), np.zeros(FILTERS),
                   rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
                   rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))


def _stack(items: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes padded to one length, a mark of value positions, and a mark of positions that exist."""
    long = max(len(c) for c, _, _ in items) + WIDTH - 1
    codes, value, real = (np.zeros((len(items), long), t) for t in (np.int64, np.float64, bool))
    for i, (c, start, end) in enumerate(items):
        codes[i, :len(c)] = c
        value[i, start:end] = 1
        real[i, :len(c)] = True
    return codes, value, real


def _windows(net: Network, codes: np.ndarray, value: np.ndarray) -> np.ndarray:
    x = np.concatenate([net.embed[codes], value[:, :, None]], 2)
    return np.concatenate([x[:, k:x.shape[1] - WIDTH + 1 + k] for k in range(WIDTH)], 2)


def _pooled(net: Network, codes: np.ndarray, value: np.ndarray, real: np.ndarray) -> tuple:
    windows = _windows(net, codes, value)
    here = real[:, :windows.shape[1]]
    act = np.maximum(windows @ net.kernel + net.kernel_bias, 0) * here[:, :, None]
    return windows, here, act


def logits(net: Network, items: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """Scores of candidates. A long value is convolved in blocks, so memory does not grow with its length."""
    out = np.empty(len(items))
    order = sorted(range(len(items)), key=lambda i: len(items[i][0]))
    for start in range(0, len(order), 256):
        group = order[start:start + 256]
        if len(items[group[-1]][0]) > 2048:
            for i in group:
                out[i] = _long_logit(net, items[i])
            continue
        _, here, act = _pooled(net, *_stack([items[i] for i in group]))
        out[group] = _head(net, act.max(1), act.sum(1) / here.sum(1)[:, None])
    return out


def _head(net: Network, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
    h = np.maximum(np.concatenate([most, mean], -1) @ net.hidden + net.hidden_bias, 0)
    return h @ net.out + net.out_bias[0]


def _long_logit(net: Network, item: tuple[np.ndarray, int, int]) -> float:
    codes, value, real = _stack([item])
    most, total, n = np.zeros(FILTERS), np.zeros(FILTERS), len(item[0])
    for a in range(0, n, 2048):
        b = min(a + 2048, n)
        _, _, act = _pooled(net, codes[:, a:b + WIDTH - 1], value[:, a:b + WIDTH - 1], real[:, a:b + WIDTH - 1])
        most, total = np.maximum(most, act[0, :b - a].max(0)), total + act[0, :b - a].sum(0)
    return float(_head(net, most, total / n))


def _gradients(net: Network, items: list, label: np.ndarray) -> list[np.ndarray]:
    codes, value, real = _stack(items)
    windows, here, act = _pooled(net, codes, value, real)
    n, count = len(items), here.sum(1)[:, None]
    best = act.argmax(1)
    pooled = np.concatenate([act.max(1), act.sum(1) / count], 1)
    pre = pooled @ net.hidden + net.hidden_bias
    h = np.maximum(pre, 0)
    z = h @ net.out + net.out_bias[0]
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
    dh = dz[:, None] * net.out * (pre > 0)
    dp = dh @ net.hidden.T
    dact = np.repeat((dp[:, FILTERS:] / count)[:, None, :], act.shape[1], 1)
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    dact[rows, best, cols] += dp[:, :FILTERS]
    dact *= act > 0
    flat = windows.reshape(-1, windows.shape[2])
    dkernel = flat.T @ dact.reshape(-1, FILTERS)
    dwin = dact @ net.kernel.T
    dx = np.zeros((n, codes.shape[1], DIM + 1))
    for k in range(WIDTH):
        dx[:, k:k + dwin.shape[1]] += dwin[:, :, k * (DIM + 1):(k + 1) * (DIM + 1)]
    dembed = np.stack([np.bincount(codes.ravel(), dx[:, :, d].ravel(), CHARS) for d in range(DIM)], 1)
    return [dembed, dkernel, dact.sum((0, 1)), pooled.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]


def fit(items: list[tuple[np.ndarray, int, int]], label: np.ndarray, recall: float = 0.995, epochs: int = 20, batch: int = 64,
        rate: float = 0.004, seed: int = 0) -> Network:
    """Fit on the even findings, calibrate and set the threshold on the odd ones."""
    rng, net = np.random.default_rng(seed), fresh(seed)
    train, held = np.arange(0, len(items), 2), np.arange(1, len(items), 2)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for start in range(0, len(order), batch):
            some = order[start:start + batch]
            step += 1
            for w, g, m, v in zip(net.weights(), _gradients(net, [items[i] for i in some], label[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, y = logits(net, [items[i] for i in held]), label[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibration curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    net.slope, net.offset = float(a), float(b)
    secret = np.sort(1 / (1 + np.exp(-np.clip(a * z[y == 1] + b, -500, 500))))
    harmless = 1 / (1 + np.exp(-np.clip(a * z[y == 0] + b, -500, 500)))
    net.threshold = float(secret[int((1 - recall) * len(secret))])
    net.recall, net.false_share = float((secret >= net.threshold).mean()), float((harmless >= net.threshold).mean())
    return net


def probabilities(net: Network, items: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * logits(net, items) + net.offset, -500, 500)))


def _text_of(rng: np.random.Generator, chars: str, n: int) -> str:
    return "".join(chars[i] for i in rng.integers(0, len(chars), n))


_ALNUM = T.UPPER + T.LOWER + "0123456789"


def _secret(rng: np.random.Generator) -> str:
    """A credential of one of the common public formats."""
    kind = rng.integers(0, 11)
    if kind == 0:
        return "AKIA" + _text_of(rng, T.UPPER + "234567", 16)
    if kind == 1:
        return "gh" + "pousr"[rng.integers(0, 5)] + "_" + _text_of(rng, _ALNUM, 36)
    if kind == 2:
        return ("sk_live_", "rk_live_", "sk_test_", "sk-")[rng.integers(0, 4)] + _text_of(rng, _ALNUM, int(rng.integers(20, 49)))
    if kind == 3:
        return "xox" + "bap"[rng.integers(0, 3)] + "-" + _text_of(rng, "0123456789", 12) + "-" + _text_of(rng, _ALNUM, 24)
    if kind == 4:
        return base64.b64encode(rng.bytes(int(rng.integers(18, 49)))).decode()
    if kind == 5:
        return "eyJ" + base64.urlsafe_b64encode(rng.bytes(int(rng.integers(24, 60)))).decode().rstrip("=")
    if kind == 6:
        return "AIza" + _text_of(rng, _ALNUM + "_-", 35)
    if kind == 7:
        return rng.bytes(int(rng.integers(12, 33))).hex().upper()
    if kind == 8:
        return _text_of(rng, T.UPPER + T.LOWER, int(rng.integers(16, 41)))
    return _text_of(rng, _ALNUM + "+/_-" if kind == 9 else _ALNUM, int(rng.integers(20, 45) if kind == 9 else rng.integers(12, 20)))


def _harmless(rng: np.random.Generator, words: list[str]) -> str:
    """An identifier that is no credential: names, paths, numbers and dates made of the document's own words."""
    ascii_words = [w for w in words if w.isascii() and w.isalpha()] or ["alpha", "value", "north"]

    def word() -> str:
        return ascii_words[rng.integers(0, len(ascii_words))].lower()

    kind = rng.integers(0, 11)
    number = str(rng.integers(0, 10**int(rng.integers(1, 7))))
    if kind == 0:
        return "_".join(word() for _ in range(rng.integers(2, 5))) + number
    if kind == 1:
        return "/" + "/".join(word() for _ in range(rng.integers(2, 6))) + "/" + number
    if kind == 2:
        return "".join(word().title() for _ in range(rng.integers(2, 5))) + number
    if kind == 3:
        return "-".join([word(), word(), f"20{rng.integers(10, 30)}", f"{rng.integers(1, 13):02}", f"{rng.integers(1, 29):02}"])
    if kind == 4:
        return f"20{rng.integers(10, 30)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(0, 24):02}-{rng.integers(0, 60):02}-00Z"
    if kind == 5:
        return word() + _text_of(rng, "0123456789", int(rng.integers(12, 20)))
    if kind == 6:
        return "ISBN-" + "-".join(_text_of(rng, "0123456789", k) for k in (3, 1, 4, 4, 1))
    if kind == 7:
        return word() * int(rng.integers(3, 6)) + number
    if kind == 8:
        return (word() + word() + word() + number)[:60].upper()
    if kind == 9:
        return "".join(word() for _ in range(rng.integers(2, 5)))
    return "".join(word().title() for _ in range(rng.integers(2, 5)))


def _neighbour(rng: np.random.Generator) -> str:
    """Now and then another credential close by, with findings of both labels, so that company alone decides nothing."""
    return f" {_secret(rng)} {('', 'and ', 'or: ')[rng.integers(0, 3)]}" if rng.integers(0, 4) == 0 else ""


def labelled_findings(texts: list[str], per_text: int = 4, seed: int = 0) -> tuple[list, np.ndarray]:
    """Secrets and harmless identifiers at word boundaries of the texts, and the texts' own candidates outside base findings."""
    rng, items, label = np.random.default_rng(seed), [], []
    for text in texts or ["", ""] * 200:
        spaces = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
        words = text[:2000].split() if texts else []  # words for harmless names; any would do
        for _ in range(per_text):
            for is_secret in (1, 0):
                value = _secret(rng) if is_secret else _harmless(rng, words)
                at = spaces[rng.integers(0, len(spaces))]
                lead = (" ", " ", "\n", ": ", " = ", ' "')[rng.integers(0, 6)]
                around = text[max(0, at - BEFORE):at] + _neighbour(rng) + lead
                items.append(encoded(around + value + text[at:at + AFTER], len(around), len(around) + len(value)))
                label.append(is_secret)
        base = base_spans(text)
        own = further_candidates(text, base)
        for start, end in (own[k] for k in rng.permutation(len(own))[:16]):
            before = text[max(0, start - BEFORE):start] + _neighbour(rng)
            items.append(encoded(before + text[start:end + AFTER], len(before), len(before) + end - start))
            label.append(0)
    order = rng.permutation(len(items))
    return [items[i] for i in order], np.array(label, float)[order]


def train(documents: DataFrame, sample_rows: int = 500, recall: float = 0.995) -> Network:
    """Fit on contexts of a bounded sample of documents; a context needs some characters about a word boundary only."""
    chosen = (documents.select("doc_id").where("doc_id is not null").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # The sample serves as context: a stretch of 4,000 characters from a hashed place keeps the driver's share bounded.
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - 4000)).cast("int") + 1
    rows = (documents.where("text is not null").select("doc_id", F.substring("text", place, F.lit(4000)).alias("text"))
            .join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"]))
    return fit(*labelled_findings(rows["text"].tolist()), recall=recall)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span], float]]:
    """Base spans, all spans, and the highest probability among a text's candidates, for each text."""
    bases = [base_spans(t) for t in texts]
    where, items = [], []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for start, end in [*dict.fromkeys((s, e) for s, e, _ in base), *further_candidates(text, base)]:
            where.append((i, start, end))
            items.append(encoded(text, start, end))
    extra: list[list[Span]] = [[] for _ in texts]
    top = [0.0] * len(texts)
    known = [{(s, e) for s, e, _ in base} for base in bases]
    for (i, start, end), p in zip(where, probabilities(net, items).tolist() if items else [], strict=True):
        top[i] = max(top[i], p)
        if p >= net.threshold and (start, end) not in known[i]:
            extra[i].append((start, end, "network"))
    return [(base, ordered([*base, *more]), p) for base, more, p in zip(bases, extra, top, strict=True)]


def find(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """Per document: counts of base spans by kind, the digest of their list, all spans, and the highest probability."""
    net = train(documents) if net is None else net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            rows = scan([t or "" for t in batch.column(1).to_pylist()], net)
            counts = [[sum(s[2] == kind for s in base) for base, _, _ in rows] for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in rows]),
                pa.array([joined(every) for _, every, _ in rows], pa.string()),
                pa.array([p for _, _, p in rows], pa.float64()),
            ], ["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans", "top_probability"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_probability double")
