"""Personal data: base patterns, plus candidates that boosted trees accept.

Base spans come from fixed patterns and their checks (see ``base_spans``) and always stay.
High-recall generators propose further, overlapping spans that look like one of the kinds but fail
a pattern or a check: written-out addresses, mistyped cards, dotted numbers, numbers without a
prefix.  Gradient-boosted trees, one ensemble per kind, score a proposal from its format and its
context; they are trained on base spans against proposals that are none, and never see the outcome
of a check.  A threshold per kind is calibrated on documents that the trees have not seen: the
lowest one whose accepted candidates are base spans with the share ``PRECISION``; without one, the
kind adds nothing.  Of overlapping proposals the best scored is kept, none may overlap a base span.

Training reads the candidates of the ``SAMPLE_DOCS`` documents with a candidate that have the
smallest hash of their id, ``SAMPLE_ROWS`` candidates at most; scanning covers whole texts.
Defined cases: a null text is empty and has no span; rows that repeat an id are scanned each;
positions count code points, ends are exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 3000
SAMPLE_ROWS = 30_000
PRECISION = 0.95
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 30, 3, 0.3, 16, 20

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is only tried from its first digit: from a later one it fails or matches the same way
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns that pass their checks, leftmost first per kind.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four numbers up to 255;
    card 14 to 19 digits with single blanks or hyphens, passing Luhn; phone ``+`` and 10 to 15
    digits.  A match that fails its check is passed over as a whole.
    """
    found: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        # the run of characters before the sign, as far as no earlier match holds them
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]? ?\b(?:at|AT)\b ?[)\]]? ?[A-Za-z0-9-]{1,63}(?: ?[(\[]? ?\b(?:dot|DOT)\b ?[)\]]? ?[A-Za-z]{2,24})+")
_BARE = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{2,63}(?![A-Za-z0-9.-])")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,23}")


def proposals(text: str) -> list[Span]:
    """Spans that look like a kind; kinds overlap and base spans are among them."""
    found: list[Span] = []
    if " at" in text or " AT" in text or "(at" in text or "[at" in text:
        # a written-out address names its dot; without that word nothing needs to be tried
        if re.search(r"\b(?:dot|DOT)\b", text):
            found += [("email", m.start(), m.end()) for m in _AT.finditer(text)]
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _BARE.finditer(text)]
    for m in _NUMBER.finditer(text):
        shape, digits = m.group(), len(_digits(m.group()))
        if 12 <= digits <= 20 and "(" not in shape and "+" not in shape:
            found.append(("card", m.start(), m.end()))
        if 9 <= digits <= 16:
            found.append(("phone", m.start(), m.end()))
        if "." in shape and 3 <= len([p for p in shape.split(".") if p.isdigit()]) <= 5:
            found.append(("ip", m.start(), m.end()))
    return found


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span; no outcome of a base check is among them."""
    _, start, end = span
    shape = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", shape)]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    words = before.split()
    last = words[-1] if words else ""
    kind_of = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    return [
        float(len(shape)), float(sum(groups)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(shape.count(".")), float(shape.count(" ")), float(shape.count("-")), float(shape.count("(")),
        float(shape.startswith("+")), float("@" in shape), float(sum(map(str.isalpha, shape))),
        kind_of(before[-1:]), kind_of(after[:1]), float(last.endswith((":", "="))), float(len(last)),
        float(last.isupper()), float(sum(map(str.isdigit, before))), float(sum(map(str.isdigit, after))),
        float(shape[0] == "0" if shape else 0),
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth: per tree a feature and a cut for each inner node."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for columns, cuts, leaves in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, columns[node]] > cuts[node])
            out += leaves[node - len(columns)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss; cuts are quantiles of each feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    out = np.full(len(y), model.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        grad, hess = p - y, p * (1 - p) + 1e-6
        columns, limits, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best, pick = 1e-6, None
            for f in range(x.shape[1]):
                g = np.bincount(binned[rows, f], grad[rows], len(cuts[f]) + 1).cumsum()
                h = np.bincount(binned[rows, f], hess[rows], len(cuts[f]) + 1).cumsum()
                gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                if len(gain) and gain.max() > best:
                    best, pick = gain.max(), (f, int(gain.argmax()))
            right = np.zeros(len(rows), bool)
            if pick:
                columns[at], limits[at] = pick[0], cuts[pick[0]][pick[1]]
                right = binned[rows, pick[0]] > pick[1]
            node[rows] = 2 * at + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        model.trees.append((columns, limits, value))
        out += value[leaf]
    return model


@dataclass
class Model:
    trees: dict[str, Trees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The accepted proposals that overlap neither a base span nor a better one."""
        held = set(base)
        tried = [s for s in dict.fromkeys(proposals(text)) if s not in held and s[0] in self.thresholds]
        scored = []
        for kind in {s[0] for s in tried}:
            mine = [s for s in tried if s[0] == kind]
            p = self.trees[kind].scores(np.array([features(text, s) for s in mine]))
            scored += [(-v, KINDS.index(kind), s) for v, s in zip(p, mine, strict=True) if v >= self.thresholds[kind]]
        # intervals taken so far, in order, so that each test looks at two neighbours
        import bisect

        taken = _merged([(s[1], s[2]) for s in base])
        kept = []
        for _, _, span in sorted(scored):
            i = bisect.bisect_right(taken, (span[1], span[1]))
            if (i == 0 or taken[i - 1][1] <= span[1]) and (i == len(taken) or taken[i][0] >= span[2]):
                taken.insert(i, (span[1], span[2]))
                kept.append(span)
        return kept


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def train(docs: DataFrame) -> Model:
    """Fit the trees and thresholds on a bounded sample of candidates."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"h": [], "kind": [], "at": [], "base": [], "x": []}
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = set(base_spans(text))
                for span in sorted(base | set(proposals(text))):
                    for name, v in zip(rows, (h, span[0], span[1], float(span in base), features(text, span)), strict=True):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("h", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("base", pa.float64()), ("x", pa.list_(pa.float64()))]))

    docs = docs.select("doc_id", "text")
    likely = docs.where(F.col("text").rlike(r"[0-9][0-9 ().-]{5}|@")).select(F.xxhash64("doc_id").alias("h"))
    chosen = likely.distinct().orderBy("h").limit(SAMPLE_DOCS)
    texts = docs.where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(chosen), "h", "left_semi")
    found = texts.select("h", "text").mapInArrow(candidates, "h long, kind string, at long, base double, x array<double>")
    rows = found.orderBy("h", "kind", "at").limit(SAMPLE_ROWS).collect()
    model = Model()
    for kind in KINDS:
        mine = [r for r in rows if r["kind"] == kind]
        x, y = np.array([r["x"] for r in mine]), np.array([r["base"] for r in mine])
        fold = np.array([r["h"] % 2 for r in mine])
        if min(sum(fold == 0), sum(fold == 1)) < LEAST_ROWS:
            continue
        trees = boost(x[fold == 0], y[fold == 0])
        p, truth = trees.scores(x[fold == 1]), y[fold == 1]
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        last = np.append(np.diff(p[order]) != 0, True)
        good = np.flatnonzero(last & (precision >= PRECISION))
        if len(good):
            model.trees[kind], model.thresholds[kind] = trees, float(max(0.5, p[order][good[-1]]))
    return model


def _named(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the digest are of the base spans; ``spans`` also has the added ones.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    counts = [f"n_{k}" for k in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(packed.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n: dict[str, list[int]] = {c: [] for c in counts}
                digests, spans = [], []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    for kind, c in zip(KINDS, counts, strict=True):
                        n[c].append(sum(s[0] == kind for s in base))
                    digests.append(hashlib.sha256(_named(base).encode()).hexdigest())
                    spans.append(_named(base + loaded.added(text or "", base)))
                arrays = [pa.array(n[c], pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrays, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", *counts, "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in counts), "base_sha256 string", "spans string"])
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of spans replaced by the kinds it holds, in brackets."""
    out, at = [], 0
    for a, b in _merged([(s[1], s[2]) for s in spans]):
        kinds = dict.fromkeys(k for k in KINDS for s in spans if s[0] == k and a <= s[1] < b)
        out += [text[at:a], f"[{'/'.join(kinds)}]"]
        at = b
    return "".join([*out, text[at:]])
