"""Personal data: a skip-chain conditional random field over token nodes.

Base spans (email, ip, card, phone) come from fixed patterns.  The field adds
spans that the patterns miss: every token with a digit or an ``@`` is a node
with one label of O, email, ip, card, phone.  A node has a potential from its
shape (with the card check sum), adjacent nodes share a chain potential, and distant nodes with the same
key (the digits, or the lower-cased letters and digits, of the token) share a
skip potential.  Nodes inside base spans are observed; loopy sum-product
message passing over chain and skip edges then gives the labels of the others, in
every document, with base spans or without,
so that an entity keeps one label in the whole document.  For that every repeat
of a key is linked with one node (the first observed one, else the first), so
edges grow with the tokens and distance does not weaken a label.  Messages pass
until they stop changing, in rounds that grow with the connected part.

Training: pseudo-likelihood with the base spans as labels.  Its sufficient
statistics are counts of (label, shape, neighbours' labels), all categorical,
(repeats in order of occurrence), so Spark counts them over all documents and only the bounded table of distinct
combinations (``MAX_CONFIGS`` by construction) reaches the driver.

Defined cases: null and empty texts have no spans; very long texts are
processed whole; repeated rows and null ids are processed alike; an empty table
trains the prior weights; other columns pass through and those named like the
added ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
NONE = len(LABELS)              # no such neighbour
N_SHAPES = 3 * 8 * 4 * 2 * 2 * 2    # see shape_of
MAX_CONFIGS = len(LABELS) * N_SHAPES * 6**4
SETTLED = 1e-6                  # change of a message below which it has stopped
SURE = 0.8

# Equal to the base patterns: lookbehinds and possessive repeats only skip
# starts that cannot match, so long runs take linear time.
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        to = at + 1
        if start < at and (m := _EMAIL_DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = to = m.end()
        at = text.find("@", to)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # Python refuses to convert very long runs of digits
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape_of(token: str) -> int:
    """A categorical shape: at sign, digits, dots, leading plus, letters, and
    whether digits as many as a card's fail its check sum (then it is none)."""
    found = "".join(_DIGIT.findall(token))
    digits = len(found)
    at = 0 if "@" not in token else 2 if "." in token.rpartition("@")[2] else 1
    size = (digits > 0) + (digits > 2) + (digits > 4) + (digits > 6) + (digits > 8) + (digits > 12) + (digits > 19)
    dots = min(token.strip(".").count("."), 3)
    letters = any(c.isalpha() for c in token)
    no_card = 13 <= digits <= 19 and not luhn(found)
    return ((((at * 8 + size) * 4 + dots) * 2 + token.startswith("+")) * 2 + letters) * 2 + no_card


def key_of(token: str) -> str:
    """What repeats of an entity have in common; empty for tokens too short to
    name one (a house number is no phone number)."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    name = "".join(c for c in token.lower() if c.isalnum())
    return digits if len(digits) >= 7 else name if len(name) >= 6 else ""


class Graph:
    """Nodes of one text and their edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        # a text may hold endless tokens without a digit: look only where digits or @ are
        nodes = _nodes(text)
        self.spans = nodes
        n = len(nodes)
        self.labels = np.zeros(n, np.int64)
        starts = np.array([a for a, _ in nodes], np.int64)
        ends = np.array([b for _, b in nodes], np.int64)
        for kind, a, b in base:
            self.labels[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = LABELS.index(kind)
        tokens = [text[a:b] for a, b in nodes]
        self.shapes = np.array([shape_of(t) for t in tokens], np.int64)
        near = [k for k in range(n - 1) if not text[nodes[k][1]:nodes[k + 1][0]].strip()]
        self.chain = np.array([(k, k + 1) for k in near], np.int64).reshape(-1, 2)
        seen: dict[str, int] = {}
        hub: dict[str, int] = {}
        skip, chained, repeats = [], set(near), []
        for k, t in enumerate(tokens):
            if key := key_of(t):
                if key in seen and not (seen[key] == k - 1 and k - 1 in chained):
                    skip.append((seen[key], k))
                seen[key] = k
                if not self.labels[hub.setdefault(key, k)]:
                    hub[key] = k if self.labels[k] else hub[key]
                repeats.append((key, k))
        self.skip = np.array(skip, np.int64).reshape(-1, 2)    # in order: what training counts
        self.links = np.array([(hub[key], k) for key, k in repeats if k != hub[key] and not self.labels[k]],
                              np.int64).reshape(-1, 2)         # to the hub: where messages pass

    def around(self) -> np.ndarray:
        """Labels of the left, right, previous and next linked node."""
        out = np.full((len(self.labels), 4), NONE, np.int64)
        for column, edges in ((0, self.chain), (2, self.skip)):
            if len(edges):
                out[edges[:, 1], column] = self.labels[edges[:, 0]]
                out[edges[:, 0], column + 1] = self.labels[edges[:, 1]]
        return out


    def parts(self) -> np.ndarray:
        """For each node one node of its connected part."""
        part = list(range(len(self.labels)))

        def root(k: int) -> int:
            while part[k] != k:
                part[k] = part[part[k]]
                k = part[k]
            return k

        for a, b in np.concatenate([self.chain, self.links]).tolist():
            part[root(a)] = root(b)
        return np.array([root(k) for k in range(len(part))], np.int64)


def _nodes(text: str) -> list[tuple[int, int]]:
    """Tokens (runs without white space) that hold a digit or an at sign."""
    return [m.span() for m in _NODE.finditer(text)]


def _marginals(graph: Graph, weights: dict) -> np.ndarray:
    n, k = len(graph.labels), len(LABELS)
    unary = weights["shape"][graph.shapes].copy()
    known = graph.labels > 0
    unary[known] = -30.0
    unary[known, graph.labels[known]] = 30.0
    edges = np.concatenate([graph.chain, graph.links])
    belief = unary
    if len(edges):
        pair = np.concatenate([np.broadcast_to(weights["chain"], (len(graph.chain), k, k)),
                               np.broadcast_to(weights["skip"], (len(graph.links), k, k))])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([pair, pair.transpose(0, 2, 1)])   # [edge, source label, target label]
        back = np.r_[len(edges):2 * len(edges), 0:len(edges)]
        message = np.zeros((2 * len(edges), k))
        roots = graph.parts()
        part, limit = roots[target], 4 * np.bincount(roots, minlength=n) + 64
        live = np.flatnonzero(~known[target])   # nothing changes an observed label
        done = 0
        while len(live):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source[live]] - message[back[live]]
            new = np.logaddexp.reduce(out[:, :, None] + both[live], axis=1)
            step = 0.5 * (new - new.max(axis=1, keepdims=True) - message[live])
            message[live] += step
            done += 1
            moving = np.zeros(n, bool)
            moving[part[live][np.abs(step).max(axis=1) > SETTLED]] = True
            live = live[(moving & (done < limit))[part[live]]]
        belief = unary.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _joined(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones (of two kinds) as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _touches(spans: list[tuple[int, int]], starts: np.ndarray, a: int, b: int) -> bool:
    k = int(np.searchsorted(starts, b)) - 1
    return k >= 0 and spans[k][1] > a


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict) -> list[tuple[str, int, int]]:
    """Spans of nodes that message passing labels, outside the base spans."""
    if not base and "@" not in text and not _DIGIT.search(text):
        return []
    graph = Graph(text, base)
    if not len(graph.labels) or (graph.labels > 0).all():
        return []
    belief = _marginals(graph, weights)
    best = belief.argmax(axis=1)
    reach = _joined(base)
    starts = np.array([a for a, _ in reach], np.int64)
    out: list[tuple[str, int, int]] = []
    sure = (graph.labels == 0) & (best > 0) & (belief.max(axis=1) >= SURE)
    for k in np.flatnonzero(sure):
        a, b = graph.spans[k]
        token = text[a:b]
        a += len(token) - len(token.lstrip(".,;:!?()[]\"'<>|"))
        b -= len(token) - len(token.rstrip(".,;:!?()[]\"'<>|"))
        if a < b and not _touches(reach, starts, a, b):
            out.append((LABELS[best[k]], a, b))
    return out


def find_spans(text: str, weights: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans (base and added) by kind, then start."""
    base = base_spans(text)
    every = sorted(base + added_spans(text, base, weights), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def _configs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and ("@" in text or _DIGIT.search(text)):
                graph = Graph(text, base_spans(text))
                rows = np.column_stack([graph.labels, graph.shapes, graph.around()])
                counts.update(map(tuple, rows.tolist()))
    names = ("label", "shape", "left", "right", "before", "after")
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(6)]
                                     + [pa.array([counts[k] for k in keys], pa.int64())], names=[*names, "n"])


def train(docs: DataFrame, steps: int = 800) -> dict:
    """Potentials by weighted pseudo-likelihood over all documents.

    The prior of chain and skip weights favours agreement (skip more than
    chain), so links still work where the corpus has few repeats.
    """
    names = ("label", "shape", "left", "right", "before", "after")
    table = (docs.select("text").mapInArrow(_configs, ", ".join(f"{c} int" for c in names) + ", n long")
             .groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).toPandas())
    k = len(LABELS)
    shape0 = np.zeros((N_SHAPES, k))
    shape0[:, 0] = 2.0
    chain0, skip0 = np.zeros((k, k)), np.zeros((k, k))
    skip0[range(1, k), range(1, k)] = 6.0
    weights = {"shape": shape0.copy(), "chain": chain0.copy(), "skip": skip0.copy()}
    if table.empty:
        return weights
    y, shape = table["label"].to_numpy(), table["shape"].to_numpy()
    n = table["n"].to_numpy().astype(float)
    sides = [(name, table[c].to_numpy(), turn) for name, c, turn in
             (("chain", "left", False), ("chain", "right", True), ("skip", "before", False), ("skip", "after", True))]
    moment = {c: np.zeros_like(w) for c, w in weights.items()}
    prior = {"shape": shape0, "chain": chain0, "skip": skip0}
    total = n.sum()
    for _ in range(steps):
        logit = weights["shape"][shape].copy()
        for name, other, turn in sides:
            has = other < k
            w = weights[name].T if turn else weights[name]
            logit[has] += w[other[has]]
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        error = p * n[:, None]
        grad = {c: 2.0 * (w - prior[c]) for c, w in weights.items()}
        np.add.at(grad["shape"], shape, error)
        for name, other, turn in sides:
            has = other < k
            g = np.zeros((k, k))
            np.add.at(g, other[has], error[has])
            grad[name] += g.T if turn else g
        for c, w in weights.items():
            moment[c] += (grad[c] / total) ** 2
            w -= 0.5 * (grad[c] / total) / (np.sqrt(moment[c]) + 1e-9)
    return weights


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


RESULT = "struct<base:string,spans:string,n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,redacted:string>"


def pii_column(text: Column, weights: dict, redact: bool) -> Column:
    """Base spans, all spans, counts of base spans and (if asked for) the text
    with every span replaced by ``<kind>``."""
    @F.arrow_udf(RESULT)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = []
            for value in part.to_pylist():
                base, every = find_spans(value or "", weights)
                kinds = Counter(kind for kind, _, _ in base)
                rows.append({"base": _text_of(base), "spans": _text_of(every),
                             "redacted": replace_spans(value, every) if redact else None,
                             **{f"n_{kind}": kinds[kind] for kind in KINDS}})
            yield pa.array(rows, pa.struct([("base", pa.string()), ("spans", pa.string()),
                                            *((f"n_{kind}", pa.int64()) for kind in KINDS),
                                            ("redacted", pa.string())]))
    return find(text)


def replace_spans(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (overlapping ones as one, named after the first) masked."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_in_documents(docs: DataFrame, weights: dict) -> DataFrame:
    """``docs`` with base, spans (both kind:start:end lists) and n_<kind>."""
    out = docs.withColumn("_pii", pii_column(F.col("text"), weights, redact=False))
    names = ("base", "spans", *(f"n_{kind}" for kind in KINDS))
    return out.withColumns({c: F.col("_pii")[c] for c in names}).drop("_pii")


def redact_documents(docs: DataFrame, weights: dict) -> DataFrame:
    """``docs`` with every found span masked in text; n_chars (if there) follows."""
    out = docs.withColumn("text", pii_column(F.col("text"), weights, redact=True)["redacted"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
