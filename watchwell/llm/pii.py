"""Personal data: exact patterns, completed by a skip-chain random field.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. Each document then becomes a small graph. Its nodes are the base spans
and every other token that looks like contact data (it holds "@" or a run of
digits). Chain edges join neighbours in the text; skip edges join each node to
the next one with the same text, or to the next similar one (the same last seven
digits, the same name before "@"), however far off. The labels are none and the four
kinds. Base spans keep their kind; loopy sum-product message passing carries it along
the edges to the other nodes, and a node whose kind is surer than
``min_probability`` becomes a further span: a number or address that is cut or
spelled otherwise in one place and complete in another.

The potentials are trained on a bounded sample of documents that have base spans
(``max_documents``, smallest hash first, ``max_nodes`` nodes at most a document). A
base span has its kind as label there, but its node doesn't show that a pattern
matched; a look-alike that no skip edge ties to a base span is none; the label of one
that is tied is hidden. The gradient is the difference of the features expected with
the known labels held and with all labels free, under the same message passing. Edges
form linked lists, so their number is linear in the nodes.

Edge cases: null and empty texts have no spans; offsets are code points, ends
exclusive; repeated rows are read separately; very long texts are read whole,
every pattern takes linear time; a table without base spans adds no spans; other
columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import appended, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
Span = tuple[str, int, int]

# An e-mail is found from its "@": what stands before it is a run of these.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20/-]{4,}[0-9]|(?<![0-9])[0-9]{5,}")
_REST = re.compile(r"\S*")
_SEEN = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CUES = {"mail": 0, "email": 0, "e-mail": 0, "ip": 1, "host": 1, "addr": 1, "card": 2, "visa": 2, "iban": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield "email", a, m.end()
            last = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind, then start."""
    found = list(_emails(text)) if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _at_tokens(text: str) -> Iterator[tuple[int, int]]:
    """The tokens between white space that hold "@"."""
    at = text.find("@")
    while at >= 0:
        a, b = at, _REST.match(text, at).end()
        while a and not text[a - 1].isspace():
            a -= 1
        yield a, b
        at = text.find("@", b)


def nodes(text: str, base: Iterable[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label) in text order: base spans, and look-alikes (label 0) beside them."""
    known = sorted((a, b, LABELS.index(kind)) for kind, a, b in base)
    out: list[tuple[int, int, int]] = []
    ends = 0
    for a, b, label in known:  # of base spans that overlap, the first
        if a >= ends:
            out.append((a, b, label))
            ends = b
    taken = [x[:2] for x in out]
    held: list[tuple[int, int]] = []
    for looks in (_at_tokens(text), (m.span() for m in _NUMBER.finditer(text))):
        taken, held = sorted([*taken, *held]), []
        stops = [x[1] for x in taken]
        for a, b in looks:
            while b > a and text[b - 1] in ".,;:!?)]}>\"'-/ ":
                b -= 1
            while a < b and text[a] in "<([{\"'":
                a += 1
            i = bisect_right(stops, a)
            if b - a > 3 and (i == len(taken) or taken[i][0] >= b):
                held.append((a, b))
                out.append((a, b, 0))
    return sorted(out)


N_FEATURES = 26
#: What agreement along an edge of each type is worth before training, and what training is drawn to.
AGREE = (0.0, 4.0, 4.0)


def features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the binary features of one node; none of them is a base pattern."""
    t = text[a:b]
    digits = len(t) - len(t.translate(_DROP_DIGITS))
    dots, ats = t.count("."), t.count("@")
    on = [0]
    on.append(1 if ats == 1 else 2 if ats else 3)
    on.append(4 + min(3, dots))
    on.append(8 + (0 if not digits else 1 if digits < 5 else 2 if digits < 9 else 3 if digits < 13 else 4 if digits < 20 else 5))
    for i, hit in enumerate((t[:1] == "+", "-" in t, " " in t, "(" in t, t.isdigit(), digits == len(t) - dots, any(c.isalpha() for c in t[:64]), "." in t.rpartition("@")[2] and ats > 0)):
        if hit:
            on.append(14 + i)
    cue = text[max(0, a - 24) : a].split()
    if cue and (k := _CUES.get(cue[-1].lower().strip(":.,;=#"))) is not None:
        on.append(22 + k)
    return on


_DROP_DIGITS = {ord(c): None for c in "0123456789"}


def _alike(text: str) -> str:
    """What similar tokens share: the name before "@", or the last seven digits; "" of shorter ones."""
    name, at, _ = text.partition("@")
    key = name + at if at else _NOT_DIGIT.sub("", text)[-7:]
    return key if len(key) >= (4 if at else 7) else ""


def edges(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 next within 40 characters, 1 next with the same text, 2 similar (_alike).

    A look-alike that is similar to base spans is tied to the first of these, however
    far, and to no other look-alike: what it is doesn't depend on how often it is
    repeated. Others are tied to the last similar or same one before.
    """
    out = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 40]
    plain = [text[a:b].lower() for a, b, _ in found]
    keys = [_alike(t) for t in plain]
    anchor: dict[str, int] = {}
    for i, (_, _, label) in enumerate(found):
        if label and keys[i]:
            anchor.setdefault(keys[i], i)
    same: dict[str, int] = {}
    alike: dict[str, int] = {}
    for i, (_, _, label) in enumerate(found):
        if not label and keys[i] in anchor:
            out.append((*sorted((anchor[keys[i]], i)), 2))
            continue
        if plain[i] in same:
            out.append((same[plain[i]], i, 1))
        if keys[i]:
            j = alike.get(keys[i])
            if j is not None and same.get(plain[i]) != j:
                out.append((j, i, 2))
            alike[keys[i]] = i
        same[plain[i]] = i
    return out


def hidden(found: list[tuple[int, int, int]], links: list[tuple[int, int, int]]) -> list[int]:
    """Labels for training: -1 for look-alikes that skip edges tie to a base span, however far."""
    root = list(range(len(found)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j, kind in links:
        if kind:
            root[top(j)] = top(i)
    tied = {top(i) for i, (_, _, label) in enumerate(found) if label}
    return [label if label or top(i) not in tied else -1 for i, (_, _, label) in enumerate(found)]


class Field:
    """Potentials: unary (features x labels) and one symmetric label matrix per edge type."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def start(cls) -> Field:
        return cls(np.zeros((N_FEATURES, len(LABELS))), np.stack([AGREE[kind] * np.eye(len(LABELS)) for kind in range(3)]))

    def beliefs(self, scores: np.ndarray, links: np.ndarray, rounds: int = 8, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of nodes, and messages (2 x edges x labels), by flooding sum-product.

        A label travels ``rounds`` edges at most. ``held``: nodes whose labels are known;
        they hear no messages, however many edges they have.
        """
        n_labels = scores.shape[1]
        i, j, kind = links[:, 0], links[:, 1], links[:, 2]
        messages = np.zeros((2, len(links), n_labels))  # 0: to j, 1: to i
        table = self.pair[kind]
        belief = scores
        for _ in range(rounds if len(links) else 0):
            to_j = _log_sum(table + (belief[i] - messages[1])[:, :, None], 1)
            to_i = _log_sum(table + (belief[j] - messages[0])[:, None, :], 2)
            new = np.stack([to_j, to_i])
            new -= new.max(axis=2, keepdims=True)
            if held is not None:
                new[0, held[j]] = 0.0
                new[1, held[i]] = 0.0
            messages = 0.5 * messages + 0.5 * new
            belief = scores.copy()
            np.add.at(belief, j, messages[0])
            np.add.at(belief, i, messages[1])
        return belief - _log_sum(belief, 1)[:, None], messages

    def pair_beliefs(self, belief: np.ndarray, messages: np.ndarray, links: np.ndarray) -> np.ndarray:
        i, j, kind = links[:, 0], links[:, 1], links[:, 2]
        joint = self.pair[kind] + (belief[i] - messages[1])[:, :, None] + (belief[j] - messages[0])[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        p = np.exp(joint)
        return p / p.sum(axis=(1, 2), keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Graph:
    """Nodes, features and edges of many documents, side by side."""

    def __init__(self):
        self.features: list[int] = []
        self.sizes: list[int] = []
        self.labels: list[int] = []
        #: Labels for training: -1 where they are hidden.
        self.hidden: list[int] = []
        self.links: list[tuple[int, int, int]] = []

    def add(self, text: str, found: list[tuple[int, int, int]], training: bool = False) -> None:
        at = len(self.labels)
        for a, b, label in found:
            on = features(text, a, b)
            self.features += on
            self.sizes.append(len(on))
            self.labels.append(label)
        links = edges(text, found)
        if training:
            self.hidden += hidden(found, links)
        self.links += [(at + i, at + j, kind) for i, j, kind in links]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return node, np.array(self.features, dtype=np.int64), np.array(self.labels, dtype=np.int64), np.array(self.links, dtype=np.int64).reshape(-1, 3)


def _unary(field: Field, node: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    scores = np.zeros((n, len(LABELS)))
    np.add.at(scores, node, field.unary[feature])
    return scores


def _expected(field: Field, scores: np.ndarray, node: np.ndarray, feature: np.ndarray, links: np.ndarray, rounds: int, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected sums of the features by label, and of the label pairs by edge type."""
    belief, messages = field.beliefs(scores, links, rounds, held)
    unary, pair = np.zeros_like(field.unary), np.zeros_like(field.pair)
    np.add.at(unary, feature, np.exp(belief)[node])
    if len(links):
        np.add.at(pair, links[:, 2], field.pair_beliefs(belief, messages, links))
    return unary, pair


def _held(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Scores with the labels that are known (0 or more) held."""
    out, known = scores.copy(), np.flatnonzero(labels >= 0)
    out[known] = -50.0
    out[known, labels[known]] = 50.0
    return out


def fit(graph: Graph, steps: int = 120, rate: float = 0.5, l2: float = 1e-3, rounds: int = 6) -> Field:
    """Potentials by gradient steps on the labels of the graph that are not hidden."""
    field = Field.start()
    node, feature, _, links = graph.arrays()
    labels = np.array(graph.hidden, dtype=np.int64)
    if not len(labels):
        return field
    start = field.pair.copy()
    size = np.bincount(feature, minlength=N_FEATURES)[:, None] + 1.0
    size_pair = np.bincount(links[:, 2], minlength=3)[:, None, None] + 1.0
    for _ in range(steps):
        scores = _unary(field, node, feature, len(labels))
        seen, seen_pair = _expected(field, _held(scores, labels), node, feature, links, rounds, labels >= 0)
        want, want_pair = _expected(field, scores, node, feature, links, rounds)
        field.unary += rate * ((seen - want) / size - l2 * field.unary)
        step = (seen_pair - want_pair) / size_pair
        field.pair += rate * ((step + step.transpose(0, 2, 1)) / 2 - l2 * (field.pair - start))
    return field


def train(docs: DataFrame, max_documents: int = 2000, max_nodes: int = 200) -> Field:
    """A field from the documents (doc_id, text), labelled by the base patterns."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                g, found = Graph(), nodes(t, base_spans(t))
                if 0 < len(found) <= max_nodes:
                    g.add(t, found, training=True)
                    node, feature, labels, links = g.arrays()
                    yield pd.DataFrame({"f": [feature.astype(np.int32).tobytes()], "s": [np.bincount(node).astype(np.int32).tobytes()], "l": [np.array(g.hidden, dtype=np.int32).tobytes()], "e": [links.astype(np.int32).tobytes()]})

    looks = docs.filter(F.col("text").rlike(r"[0-9]{7}|@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]"))
    ids = looks.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    sample = looks.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")
    whole = Graph()
    for r in sample.mapInPandas(pick, "f binary, s binary, l binary, e binary").orderBy("f", "e", "l", "s").limit(max_documents).collect():
        at = len(whole.labels)
        whole.features += np.frombuffer(r.f, np.int32).tolist()
        whole.sizes += np.frombuffer(r.s, np.int32).tolist()
        whole.labels += np.frombuffer(r.l, np.int32).tolist()
        whole.hidden += np.frombuffer(r.l, np.int32).tolist()
        whole.links += [(at + i, at + j, k) for i, j, k in np.frombuffer(r.e, np.int32).reshape(-1, 3).tolist()]
    return fit(whole)


def find(texts: list[str | None], field: Field, min_probability: float = 0.9) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of every text."""
    graph, where, out = Graph(), [], []
    for k, text in enumerate(texts):
        base: list[Span] = []
        if text and _SEEN.search(text):
            base = base_spans(text)
            found = nodes(text, base)
            if any(label == 0 for *_, label in found):
                graph.add(text, found)
                where += [(k, a, b) for a, b, _ in found]
        out.append((base, []))
    node, feature, labels, links = graph.arrays()
    if len(labels):
        fixed = labels > 0
        scores = _held(_unary(field, node, feature, len(labels)), np.where(fixed, labels, -1))
        p = np.exp(field.beliefs(scores, links, held=fixed)[0])
        best = p[:, 1:].argmax(axis=1) + 1
        sure = ~fixed & (p[np.arange(len(p)), best] >= min_probability)
        for at in np.flatnonzero(sure):
            k, a, b = where[at]
            out[k][1].append((LABELS[best[at]], a, b))
    return out


def joined(spans: Iterable[Span]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str | None, spans: Iterable[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the union."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Columns of docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""

    def compute(texts: list[str | None]) -> list[list]:
        found = find(texts, field)
        counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        return [*counts, digests, [joined([*base, *more]) for base, more in found]]

    return appended(docs, "text", "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", compute)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every found span of its text replaced by its kind."""
    kinds, names = dict(docs.dtypes), docs.columns

    def compute(texts: list[str | None]) -> list[list]:
        return [[masked(t, [*base, *more]) for t, (base, more) in zip(texts, find(texts, field), strict=True)]]

    masks = appended(docs, "text", "watchwell_masked string", compute)
    return masks.withColumn("text", F.col("watchwell_masked").cast(kinds["text"])).select(*names)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
