"""Personal data by a skip-chain conditional random field over the numbers and addresses of a document.

Patterns give the base spans: e-mail addresses, IP addresses, card and phone numbers, each
kind leftmost and non-overlapping, with its check (parts up to 255, digits and Luhn sum,
digits); a failing match is dropped and not tried again. Base spans always stay.

The field labels what the patterns leave open. Its nodes are the base spans, whose labels
are observed, and every other number of at least LEAST_DIGITS digits (no letter next to it) or
address-like token that overlaps no base span. Neighbours in the text share chain potentials. Distant nodes
share skip potentials if they are equal or similar: equal once case and separators are gone,
or then a single deleted, added or changed character apart (both have a common string with
one character less), or numbers with the same last nine digits. A bucket of similar nodes is
a star around its first observed node, else its first, so links grow with the nodes and not
with the pairs. Loopy sum-product message passing with a fixed number of rounds gives each
open node its label; it becomes a span if a kind has a probability of at least one half.
So a card number with a mistyped digit is found where the right one stands elsewhere in the
document, and an unrelated number of as many digits is left alone.

The weights are trained here, without labelled rows: on at most TRAINING documents with a
base span and up to TRAINING_NODES nodes, those with the least hashes, some base spans are
hidden, and copies that were changed as people change them, and random numbers of the same
form, are put beside them. Message passing gives the gradient of the conditional likelihood.

Texts are scanned once, whole; only nodes are kept for the rest. A null text is empty; texts
without digits and @ have no spans. Ids may be null or repeated: a document is its row.
Spans are in code points, ends exclusive. Without a base span to learn from there are no
added spans. Columns of the input under other names are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import ensure_folder, extended, share, stage

KINDS = ("email", "ip", "card", "phone")
#: Documents and nodes per document that training reads at most.
TRAINING, TRAINING_NODES = 1_000, 200
#: Numbers with fewer digits are no nodes unless a base span covers them.
LEAST_DIGITS = 7
#: Strings beyond this length are similar only if they are equal.
SIMILAR_LENGTH = 64
#: Rounds of message passing, share of the old message kept in each, gradient steps and pull towards zero.
ROUNDS, DAMPING, STEPS, RATE, PULL = 10, 0.3, 100, 0.1, 2e-3
#: A node is a span if one kind has at least this probability.
THRESHOLD = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_OPEN = re.compile(
    r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)*+"
)
_AT_WORDS = re.compile(r"[\[(](?:at|dot|AT|DOT)[\])]")
_PIECE = re.compile(r"[^ ]+")
_OBSERVABLE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((2 * d) % 10 + d // 5 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Address spans; the part before an @ is looked up backwards, which takes linear time on any text."""
    free = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            free = found.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches of the patterns that pass their checks, by kind and start."""
    if not text or not _OBSERVABLE.search(text):
        return []
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    kind: str | None
    surface: str


def nodes_of(text: str) -> list[Node]:
    """Base spans and what else may be personal data, by start."""
    base = base_spans(text)
    found = [Node(s, e, kind, text[s:e]) for kind, s, e in base]
    if text and _OBSERVABLE.search(text):
        taken = sorted((s, e) for _, s, e in base)
        at = 0
        reach = 0  # no base span before the candidate ends later
        for m in _OPEN.finditer(text):
            if m.end() - m.start() < LEAST_DIGITS:
                continue
            spans = [m.span()]
            if "@" not in m[0] and m[0][-1].isdigit() and len(_NOT_DIGIT.sub("", m[0])) > 19:
                spans = [(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m[0])]
            for s, e in spans:
                surface = text[s:e]
                if not ("@" in surface or _AT_WORDS.search(surface) or len(_NOT_DIGIT.sub("", surface)) >= LEAST_DIGITS):
                    continue
                while at < len(taken) and taken[at][0] < e:
                    reach = max(reach, taken[at][1])
                    at += 1
                if reach <= s:
                    found.append(Node(s, e, None, surface))
    return sorted(found, key=lambda n: (n.start, n.end, n.kind or ""))


def _is_address(surface: str) -> bool:
    return "@" in surface or _AT_WORDS.search(surface) is not None


def _key(surface: str) -> tuple[str, str]:
    """Family, and the surface without case and separators."""
    if _is_address(surface):
        return "a", "".join(c for c in _AT_WORDS.sub("", surface).lower() if c.isalnum())
    return "n", _NOT_DIGIT.sub("", surface)


FEATURES = (
    "any", "address", "at sign", "plus", "bracket", "hyphen", "space", "luhn", "parts", "dots 1", "dots 2", "dots 3", "dots 4",
    *(f"digits {n}" for n in range(21)), "alone",
)
_FEATURE = {name: k for k, name in enumerate(FEATURES)}


def features_of(surface: str, linked: bool) -> list[int]:
    digits = _NOT_DIGIT.sub("", surface)
    dots = min(surface.count("."), 4)
    parts = surface.split(".")
    names = ["any"]
    names += ["address"] if _is_address(surface) else [f"digits {min(len(digits), 20)}"]
    names += ["at sign"] if "@" in surface else []
    names += [n for n, c in (("plus", "+"), ("bracket", "("), ("hyphen", "-"), ("space", " ")) if c in surface]
    names += ["luhn"] if 13 <= len(digits) <= 19 and luhn(digits) else []
    names += ["parts"] if len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts) else []
    names += [f"dots {dots}"] if dots else []
    names += [] if linked else ["alone"]
    return [_FEATURE[n] for n in names]


# Potentials between nodes: neighbours in the text, equal and similar nodes.
CHAIN, EQUAL, SIMILAR = range(3)


def links_of(surfaces: Sequence[str], observed: Sequence[bool]) -> list[tuple[int, int, int]]:
    """(i, j, potential): neighbours, and a star for every bucket of equal or similar nodes."""
    chain = [(i, j, CHAIN) for i, j in pairwise(range(len(surfaces)))]
    keys = [_key(s) for s in surfaces]
    same: dict[tuple, list[int]] = defaultdict(list)
    for i, key in enumerate(keys):
        same[key].append(i)
    hubs, skips = {}, {}
    for key, members in same.items():
        hubs[key] = hub = next((i for i in members if observed[i]), members[0])
        skips |= {(min(i, hub), max(i, hub)): EQUAL for i in members if i != hub}
    near: dict[tuple, list[int]] = defaultdict(list)
    for (family, string), hub in hubs.items():
        forms = {string}
        if len(string) <= SIMILAR_LENGTH:
            forms |= {string[:k] + string[k + 1 :] for k in range(len(string))}
        for form in forms:
            near[family, form].append(hub)
        if family == "n" and len(string) >= 9:
            near["tail", string[-9:]].append(hub)
    for members in near.values():
        hub = next((i for i in members if observed[i]), members[0])
        for i in members:
            if i != hub:
                skips.setdefault((min(i, hub), max(i, hub)), SIMILAR)
    return chain + [(i, j, kind) for (i, j), kind in sorted(skips.items())]


@dataclass
class Graph:
    """Nodes of many documents: features (node, feature), clamped labels (-1 if open), edges and their potentials."""

    n: int
    at: np.ndarray
    feature: np.ndarray
    label: np.ndarray
    ends: np.ndarray
    potential: np.ndarray


def graph_of(documents: Sequence[tuple[Sequence[str], Sequence[int]]]) -> Graph:
    """The graph of documents, each given by the surfaces and observed labels (-1: open) of its nodes."""
    at, feature, labels, ends, kinds, first = [], [], [], [], [], 0
    for surfaces, label in documents:
        links = links_of(surfaces, [x >= 0 for x in label])
        linked = {i for a, b, kind in links if kind != CHAIN for i in (a, b)}
        for i, surface in enumerate(surfaces):
            found = features_of(surface, i in linked)
            at += [first + i] * len(found)
            feature += found
        labels += label
        ends += [(first + a, first + b) for a, b, _ in links]
        kinds += [kind for _, _, kind in links]
        first += len(surfaces)
    return Graph(
        first, np.array(at, np.int64), np.array(feature, np.int64), np.array(labels, np.int64),
        np.array(ends, np.int64).reshape(-1, 2), np.array(kinds, np.int64),
    )


@dataclass
class Field:
    """Weights: of features by label (none, then KINDS), and of label pairs by potential."""

    unary: np.ndarray
    pair: np.ndarray

    @staticmethod
    def zero() -> Field:
        size = len(KINDS) + 1
        return Field(np.zeros((len(FEATURES), size)), np.zeros((3, size, size)))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Column sums of ``values`` by the row numbers ``at``, added in order."""
    return np.stack([np.bincount(at, values[:, y], n) for y in range(values.shape[1])], axis=1)


def _message(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log of the normalised sum over the first label of exp(x) * weight."""
    out = np.einsum("ea,eab->eb", np.exp(x - x.max(axis=1, keepdims=True)), weight)
    return np.log(out / out.sum(axis=1, keepdims=True))


def beliefs(field: Field, graph: Graph, clamped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes and of edges, by loopy sum-product with ``clamped`` labels fixed (-1: open)."""
    own = _sums(graph.at, field.unary[graph.feature], graph.n)
    fixed = np.flatnonzero(clamped >= 0)
    own[fixed] = -50.0
    own[fixed, clamped[fixed]] = 0.0
    i, j = graph.ends[:, 0], graph.ends[:, 1]
    weight = np.exp(field.pair)[graph.potential]
    turned = weight.transpose(0, 2, 1)
    to_j = np.zeros((len(i), own.shape[1]))
    to_i = np.zeros_like(to_j)
    total = own
    for _ in range(ROUNDS):
        out_j, out_i = _message(total[i] - to_i, weight), _message(total[j] - to_j, turned)
        to_j = DAMPING * to_j + (1 - DAMPING) * out_j
        to_i = DAMPING * to_i + (1 - DAMPING) * out_i
        total = own + _sums(j, to_j, graph.n) + _sums(i, to_i, graph.n)
    nodes = np.exp(total - total.max(axis=1, keepdims=True))
    x, y = total[i] - to_i, total[j] - to_j
    x, y = (np.exp(v - v.max(axis=1, keepdims=True)) for v in (x, y))
    edges = x[:, :, None] * y[:, None, :] * weight
    return nodes / nodes.sum(axis=1, keepdims=True), edges / edges.sum(axis=(1, 2), keepdims=True)


def _changed(surface: str, dice: random.Random) -> str:
    """The surface as someone might have written it again."""
    digits = [k for k, c in enumerate(surface) if c.isdigit()]
    way = dice.randrange(4)
    if way == 0 and digits:
        k = dice.choice(digits)
        return surface[:k] + str((int(surface[k]) + dice.randrange(1, 10)) % 10) + surface[k + 1 :]
    if way == 1 and digits:
        k = dice.choice(digits)
        return surface[:k] + surface[k + 1 :]
    if way == 2:
        return surface.replace("@", " [at] ") if "@" in surface else re.sub(r"[ ().+-]+", dice.choice(["", "-", "."]), surface).strip("-.")
    return surface.lstrip("+") if "+" in surface else surface


def _random_like(surface: str, dice: random.Random) -> str:
    return re.sub("[0-9]", lambda _: str(dice.randrange(10)), surface)


def _lesson(nodes: Sequence[tuple[str, str | None]], seed: int) -> tuple[list[str], list[int], list[int]]:
    """Surfaces, shown labels and true labels (-1: shown and true unknown) of one training document."""
    dice = random.Random(seed)
    links = [(i, j) for i, j, potential in links_of([s for s, _ in nodes], [k is not None for _, k in nodes]) if potential != CHAIN]
    unclear = {b for i, j in links for a, b in ((i, j), (j, i)) if nodes[a][1] and not nodes[b][1]}
    surfaces, shown, truth = [], [], []
    for k, (surface, kind) in enumerate(nodes):
        label = KINDS.index(kind) + 1 if kind else 0
        if k in unclear:  # like a base span, but not said to be one
            continue
        surfaces.append(surface)
        shown.append(label if kind and dice.random() < 0.7 else -1)
        truth.append(label)
        if kind is None:
            continue
        if dice.random() < 0.5:
            surfaces.append(_changed(surface, dice))
            shown.append(-1)
            truth.append(label if shown[-2] >= 0 or surfaces[-1] == surface else -1)
        if "@" not in surface and dice.random() < 0.5:
            other = _random_like(surface, dice)
            base = {k for k, _, _ in base_spans(other)}
            if not base:
                surfaces.append(other)
                shown.append(-1)
                truth.append(0)
    return surfaces, shown, truth


def train(documents: Sequence[tuple[Sequence[tuple[str, str | None]], int]]) -> Field | None:
    """The field learnt from documents, each a list of (surface, kind or None) and a seed; None without any."""
    lessons = [_lesson(nodes, seed) for nodes, seed in documents if any(kind for _, kind in nodes)]
    if not lessons:
        return None
    graph = graph_of([(surfaces, shown) for surfaces, shown, _ in lessons])
    truth = np.array([t for _, _, truths in lessons for t in truths], np.int64)
    shown = graph.label
    full = np.where(truth >= 0, truth, shown)
    field = Field.zero()
    params = (field.unary, field.pair)
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        moments = []
        for clamp in (full, shown):
            nodes, edges = beliefs(field, graph, clamp)
            unary = _sums(graph.feature, nodes[graph.at], len(FEATURES))
            pair = np.stack([edges[graph.potential == kind].sum(axis=0) for kind in (CHAIN, EQUAL, SIMILAR)])
            moments.append((unary, (pair + pair.transpose(0, 2, 1)) / 2))
        for k, param in enumerate(params):
            gradient = (moments[0][k] - moments[1][k]) / len(lessons) - PULL * param
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.999 * second[k] + 0.001 * gradient**2
            param += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return field


def label_nodes(field: Field, documents: Sequence[Sequence[tuple[str, str | None]]]) -> list[list[str | None]]:
    """The kind of every node of every document: its own if it has one, else what the field gives."""
    graph = graph_of([([s for s, _ in nodes], [KINDS.index(k) + 1 if k else -1 for _, k in nodes]) for nodes in documents])
    marginals, _ = beliefs(field, graph, graph.label)
    out, first = [], 0
    for nodes in documents:
        kinds = []
        for i, (_, kind) in enumerate(nodes):
            best = int(marginals[first + i, 1:].argmax())
            added = KINDS[best] if marginals[first + i, 1 + best] >= THRESHOLD else None
            kinds.append(kind or added)
        out.append(kinds)
        first += len(nodes)
    return out


_NODES = "nodes array<struct<start:int,end:int,kind:string,surface:string>>"
SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def _scanned(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surface", pa.string())]))
        for batch in batches:
            nodes = [
                [{"start": n.start, "end": n.end, "kind": n.kind, "surface": n.surface} for n in nodes_of(value or "")]
                for value in (scalar.as_py() for scalar in batch.column(text))
            ]
            keep = [k for k, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(nodes, kind)], [*(batch.schema.names[k] for k in keep), "nodes"]
            )

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the nodes of every document, staged; texts are read once."""
    ensure_folder(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stage(narrow.mapInArrow(_scanned("text"), extended(narrow.schema, _NODES, ["doc_id"])), "pii-nodes")


def fit(scanned: DataFrame) -> Field | None:
    """The field, from a bounded sample of the scanned documents that have a base span."""
    marked = F.exists("nodes", lambda n: n["kind"].isNotNull()) & (F.size("nodes") <= TRAINING_NODES)
    sample = scanned.where(marked).select("nodes", F.xxhash64("doc_id", F.to_json("nodes")).alias("seed"))
    rows = sample.orderBy("seed").limit(TRAINING).collect()
    return train([([(n["surface"], n["kind"]) for n in r["nodes"]], r["seed"]) for r in rows])


def with_spans(scanned: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and spans (kind, start, end, and whether it is a base span), by kind in the order of KINDS and start."""
    model = share(scanned.sparkSession, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, rank = model(), {kind: k for k, kind in enumerate(KINDS)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            documents = batch.column("nodes").to_pylist()
            surfaces = [[(n["surface"], n["kind"]) for n in nodes] for nodes in documents]
            labels = label_nodes(field, surfaces) if field else [[k for _, k in nodes] for nodes in surfaces]
            spans = [
                sorted(
                    ({"kind": k, "start": n["start"], "end": n["end"], "base": n["kind"] is not None} for n, k in zip(nodes, given) if k),
                    key=lambda s: (rank[s["kind"]], s["start"], s["end"]),
                )
                for nodes, given in zip(documents, labels, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return scanned.select("doc_id", "nodes").mapInArrow(run, extended(scanned.select("doc_id").schema, SPANS))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans of every row of ``docs``."""
    scanned = scan(docs, doc_id, text)
    return with_spans(scanned, fit(scanned))


def masked(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by their kinds, as in ``<card>``; overlapping spans are replaced by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, -end)
    return "".join(out) + text[at:]
