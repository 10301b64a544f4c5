"""Personal data: patterns, and a skip-chain conditional random field that carries labels over to related tokens.

Nodes of the field are tokens with a digit or @; all others can't be personal data here. Neighbouring tokens share an
edge, and so do distant ones that are equal or end in the same digits (a skip edge, from each to the next such token).
The factors are trained piece by piece on counts over all documents, with the patterns' spans as labels: labels given
a token's shape, label pairs given an edge of either kind. Secrets (keys, digests, passwords made by machines) have no
pattern in the base; they are labelled weakly, by their length and mix of signs. Loopy message passing then gives each
token its marginals, so a number that is a phone number in one place is one where it stands alone, too. Spans that are
found are added to those of the patterns. A document's result doesn't depend on what else is in its batch.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS, "secret")
SECRET = len(KINDS) + 1
#: Weak label of secrets: signs of keys only, long, with digits and letters in turns.
SECRETS = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
TURNS = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")
#: Fewest and most digits of a value that white space may cut into several tokens; values of other kinds are one token.
CUT = {KINDS.index("card") + 1: (13, 19), KINDS.index("phone") + 1: (9, 15)}
#: Marginal probability from which on a token becomes a span.
SURE = 0.6
#: Rounds of message passing at most, and the share of a message that is kept in each.
ROUNDS, DAMPING = 30, 0.3
#: Tokens are hashed to so many shapes at most.
SHAPES = 4096
ROWS = 1000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = re.compile(r"[0-9@]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the usual check of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern; a local part reaches back to the last other character, so each @ is looked at once."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if found:
            out.append((start, found.end()))
            low = found.end()
        at = text.find("@", low)
    return out


def ips(text: str) -> list[Span]:
    """Four numbers of at most 255 joined by dots; of longer chains, four after four."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each kind, in the order of KINDS."""
    if not SIGNS.search(text):
        return [[], [], [], []]
    return [emails(text), ips(text), cards(text), phones(text)]


@dataclass
class Tokens:
    """Nodes of a document: spans without outer punctuation, shapes, labels by pattern, edges (a, b, kind), and numbers of digits."""

    spans: list[Span]
    shapes: list[int]
    labels: list[int]
    edges: list[tuple[int, int, int]]
    digits: list[int]


def looks_secret(token: str) -> bool:
    """Whether a token is one long key: no other signs, and digits next to letters in four places at least."""
    return bool(SECRETS.fullmatch(token)) and len(TURNS.findall(token)) >= 4


def shape_of(token: str) -> int:
    """What the field sees of a token: its signs, roughly how many digits, and whether these could be a card's."""
    digits = "".join(c for c in token if c in "0123456789")
    size = next(i for i, most in enumerate((0, 2, 4, 6, 8, 12, 15, 19, 1 << 60)) if len(digits) <= most)
    signs = "".join(s for s in "@+().-_%=:/" if s in token)
    parts = min(token.count("."), 4) if digits else 0
    letters = any(c.isalpha() for c in token)
    check = 13 <= len(digits) <= 19 and luhn(digits)
    return int.from_bytes(hashlib.blake2b(f"{size}|{signs}|{parts}|{letters}|{check}|{looks_secret(token)}".encode(), digest_size=4).digest(), "little") % SHAPES


def keys_of(token: str) -> list[str]:
    """Tokens that share a key are related: the token itself (one with @ in lower case), and the last seven digits of others."""
    if "@" in token:
        return [token.lower()]
    digits = "".join(c for c in token if c in "0123456789")
    return [token, f"*{digits[-7:]}"] if len(digits) >= 7 else [token]


def tokens_of(text: str, base: list[list[Span]]) -> Tokens:
    """The nodes and edges of a text. A null-free text of any length takes time in proportion to it."""
    out, end = Tokens([], [], [], [], []), 0
    marked = sorted((a, b, kind) for kind, spans in enumerate(base, 1) for a, b in spans)
    last: dict[str, int] = {}
    previous_end, nearest = -1, 0
    for m in SIGNS.finditer(text):
        if m.start() < end:
            continue
        start, end = m.start(), m.end()
        while start > previous_end + 1 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        raw = text[start:end]
        a = start + len(raw) - len(raw.lstrip("\"'(<[{,;:"))
        b = end - len(raw) + len(raw.rstrip("\"')>]}.,;:!?*#&$%|"))
        if b <= a:
            a, b = start, end
        token, i = text[a:b], len(out.spans)
        while nearest < len(marked) and marked[nearest][1] <= a:
            nearest += 1
        label = next((kind for x, y, kind in marked[nearest : nearest + 4] if x < b and a < y), SECRET if looks_secret(token) else 0)
        out.spans.append((a, b))
        out.shapes.append(shape_of(token))
        out.labels.append(label)
        out.digits.append(sum(c in "0123456789" for c in token))
        if i and text[previous_end:start].isspace():
            out.edges.append((i - 1, i, 0))
        keys = keys_of(token)
        # The token before may share both keys; that is one edge.
        out.edges.extend((j, i, 1) for j in sorted({last[k] for k in keys if k in last}))
        last.update((k, i) for k in keys)
        previous_end = end
    return out


@dataclass
class Field:
    """Log factors: shapes x labels, and for edges of either kind labels x labels."""

    node: np.ndarray
    edge: np.ndarray

    @classmethod
    def of(cls, shapes: np.ndarray, pairs: np.ndarray) -> Field:
        """From counts of labels by shape (SHAPES x labels) and of label pairs by kind of edge (2 x labels x labels)."""
        smooth = shapes + 0.5 * shapes.sum(axis=0) / max(shapes.sum(), 1) + 0.01
        node = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        both = pairs + pairs.transpose(0, 2, 1) + 0.5
        alone = both.sum(axis=2) / both.sum(axis=(1, 2))[:, None]
        edge = np.log(both / both.sum(axis=(1, 2), keepdims=True) / alone[:, :, None] / alone[:, None, :])
        return cls(node, np.clip(edge, -4, 4))

    def marginals(self, shapes: np.ndarray, edges: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each node, by sum-product message passing over edges (rows a, b, kind).

        owner: the document of each node; each document's messages stop when they have converged.
        """
        node = self.node[shapes]
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factor = self.edge[np.concatenate([edges[:, 2], edges[:, 2]])]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), node.shape[1]))
        owner = np.zeros(len(shapes), np.int64) if owner is None else owner
        of, moving = owner[source], np.ones(len(source), bool)
        belief = node
        for _ in range(ROUNDS if len(edges) else 0):
            out = (belief[source] - sent[back])[:, :, None] + factor
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.zeros(int(of.max()) + 1)
            np.maximum.at(change, of, np.abs(new - sent).max(axis=1))
            sent = np.where(moving[:, None], DAMPING * sent + (1 - DAMPING) * new, sent)
            moving &= change[of] >= 1e-4
            belief = node.copy()
            np.add.at(belief, target, sent)
            if not moving.any():
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> Field:
    """Counts over all texts of docs (column text, no nulls); their number is bounded by shapes and labels."""

    def count(frames):
        for frame in slices(frames, ROWS):
            seen: Counter = Counter()
            for text in frame["text"]:
                nodes = tokens_of(text, base_spans(text))
                seen.update((0, s, y) for s, y in zip(nodes.shapes, nodes.labels))
                seen.update((1 + kind, nodes.labels[a], nodes.labels[b]) for a, b, kind in nodes.edges)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["factor", "a", "b", "n"]).astype("int64")

    counts = docs.select("text").mapInPandas(count, "factor long, a long, b long, n long").groupBy("factor", "a", "b").agg(F.sum("n").alias("n"))
    shapes, pairs = np.zeros((SHAPES, len(LABELS))), np.zeros((2, len(LABELS), len(LABELS)))
    for factor, a, b, n in counts.collect():
        if factor:
            pairs[factor - 1, a, b] = n
        else:
            shapes[a, b] = n
    return Field.of(shapes, pairs)


def added_spans(nodes: list[Tokens], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the field adds to each document's patterns.

    Neighbouring tokens of a kind are one span if they are parts of one value: neither is whole by itself, and together they
    aren't too long. Two numbers side by side stay two.
    """
    shapes, edges, owner, first = [], [], [], 0
    for i, t in enumerate(nodes):
        shapes += t.shapes
        owner += [i] * len(t.spans)
        edges += [(a + first, b + first, kind) for a, b, kind in t.edges]
        first += len(t.spans)
    p = field.marginals(np.asarray(shapes, np.int64), np.asarray(edges, np.int64).reshape(-1, 3), np.asarray(owner, np.int64)) if shapes else np.empty((0, len(LABELS)))
    out, at = [], 0
    for t in nodes:
        found: list[tuple[int, int, int]] = []
        close = {(a, b) for a, b, kind in t.edges if kind == 0}
        previous, so_far = None, 0
        for i, (span, label, digits) in enumerate(zip(t.spans, t.labels, t.digits)):
            best = int(p[at + i].argmax())
            if 0 < label < SECRET or not best or p[at + i, best] < SURE:
                continue
            least, most = CUT.get(best, (0, 0))
            part = max(so_far, digits) < least and so_far + digits <= most
            if previous == i - 1 and (i - 1, i) in close and found[-1][0] == best and part:
                found[-1], so_far = (best, found[-1][1], span[1]), so_far + digits
            else:
                found.append((best, *span))
                so_far = digits
            previous = i
        at += len(t.spans)
        out.append(found)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added) per row: arrays of (kind, start, end), in code points, ends exclusive."""

    def work(frames):
        for frame in slices(frames, ROWS):
            base = [base_spans(t) for t in frame["text"]]
            nodes = [tokens_of(t, b) for t, b in zip(frame["text"], base)]
            more = [[(LABELS[k], a, b) for k, a, b in x] for x in added_spans(nodes, field)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": [[(KINDS[k], a, b) for k, s in enumerate(x) for a, b in s] for x in base], "added": more})

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id long, base {spans}, added {spans}")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) per row of docs; the field is trained on all of them.

    A null text counts as empty and has no spans. Repeated rows get equal results; an empty table gives an empty table;
    other columns are not read, whatever their names. Added spans never overlap a pattern's.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return find(texts, train(texts))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*(x for i, k in enumerate(LABELS[1:]) for x in (F.lit(k), F.lit(i))))

    def text(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
