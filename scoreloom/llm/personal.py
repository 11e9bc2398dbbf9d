"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these base spans
stay. A random field then labels the other tokens that hold a digit or an at sign. Its
factors: one per token (shape, length, word before), one per pair of neighbouring tokens,
and one per skip edge, which ties a token to the next one of the document with the same
letters and digits, or, more weakly, the same shape. Loopy sum-product messages run over
all documents of a chunk together; tokens in base spans are held at their label, so
a mention that the patterns miss takes the label of its repeats if its own evidence allows.

Training is piecewise: token factors by softmax regression, pair and skip factors from
counts of label pairs, on at most ``sample_docs`` documents labelled by the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import byte_values, chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
BITS = 14

# An address is found from its at sign, so that a long run of letters is read once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
EDGES = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})
RUNS = re.compile(r"(.)\1+")


def _bucket(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") >> (32 - BITS)


class Tokens:
    """Tokens of documents with a digit or an at sign, their features, base labels and edges."""

    FEATURES = 6

    def __init__(self, texts: list[str]):
        self.base = [base_spans(t) for t in texts]
        self.place: list[tuple[int, int, int]] = []  # document, start, end
        labels, features, near, skip = [], [], [], []
        for d, text in enumerate(texts):
            spans = sorted((a, b, k) for k, a, b in self.base[d])
            same: dict[str, int] = {}
            alike: dict[str, int] = {}
            last_end, i = -2, 0
            for m in TOKEN.finditer(text):
                core = m[0].strip(EDGES)
                if not core:
                    continue
                start = m.start() + m[0].index(core)
                end, n = start + len(core), len(self.place)
                while i < len(spans) and spans[i][1] <= start:
                    i += 1
                # a span overlaps from the left or begins inside; of several the first counts
                labels.append(next((k + 1 for a, b, k in spans[max(0, i - 1):i + 4] if a < end and b > start), 0))
                shape = core[:200].translate(SHAPES)
                short = RUNS.sub(r"\1", shape)
                before = text[max(0, m.start() - 24):m.start()].split()
                digits = sum(c in "0123456789" for c in core)
                features.append([_bucket("s", shape[:24]), _bucket("r", short[:24]), _bucket("n", min(digits, 24), min(len(core), 40)), _bucket("b", before[-1].lower().strip(EDGES).translate(SHAPES) if before else ""), _bucket("c", "@" in core, "." in core, "-" in core, core[0] == "+"), _bucket("1")])
                if m.start() - last_end <= 1:
                    near.append((n - 1, n))
                last_end = m.end()
                key = "".join(c for c in core.lower() if c.isalnum())
                if len(key) >= 4:
                    if key in same:
                        skip.append((same[key], n, 0))
                    same[key] = n
                    if shape in alike and (not skip or skip[-1][1] != n):
                        skip.append((alike[shape], n, 1))
                    alike[shape] = n
                self.place.append((d, start, end))
        self.labels = np.array(labels, np.int64)
        self.features = np.array(features, np.int64).reshape(len(labels), self.FEATURES)
        self.near = np.array(near, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 3)


@dataclass
class Field:
    """Log factors: tokens (buckets x labels), neighbours and two kinds of skip edges (labels x labels)."""

    token: np.ndarray
    near: np.ndarray
    skip: np.ndarray


def train(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Piecewise factors from (features, labels, neighbour label pairs, skip label pairs) of documents."""
    token = np.zeros((1 << BITS, LABELS))
    near, skip = np.ones((LABELS, LABELS)), np.ones((2, LABELS, LABELS))
    for _, _, a, b in parts:
        np.add.at(near, (a[:, 0], a[:, 1]), 1)
        np.add.at(skip, (b[:, 2], b[:, 0], b[:, 1]), 1)
    features = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, Tokens.FEATURES), np.int64)
    labels = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    if len(labels):
        goal = np.eye(LABELS)[labels]
        square = np.full_like(token, 1e-8)
        for _ in range(rounds):
            z = token[features].sum(axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = decay * token
            np.add.at(slope, features.ravel(), np.repeat((p - goal) / len(labels), Tokens.FEATURES, axis=0))
            square += slope * slope
            token -= rate * slope / np.sqrt(square)

    def ratio(counts: np.ndarray) -> np.ndarray:  # how much more often than by chance two labels meet
        share = counts / counts.sum()
        return np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))

    return Field(token, ratio(near), np.stack([ratio(skip[0]), 0.5 * ratio(skip[1])]))


def marginals(tokens: Tokens, field: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities by loopy sum-product; base tokens keep their label."""
    n = len(tokens.labels)
    unary = field.token[tokens.features].sum(axis=1)
    unary -= np.log(np.exp(unary - unary.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + unary.max(axis=1, keepdims=True)
    fixed = np.flatnonzero(tokens.labels)
    unary[fixed] = -30.0
    unary[fixed, tokens.labels[fixed]] = 0.0
    a = np.concatenate((tokens.near[:, 0], tokens.skip[:, 0]))
    b = np.concatenate((tokens.near[:, 1], tokens.skip[:, 1]))
    factor = np.concatenate((np.broadcast_to(field.near, (len(tokens.near), LABELS, LABELS)), field.skip[tokens.skip[:, 2]]))
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    factor = np.exp(np.concatenate((factor, factor.transpose(0, 2, 1))))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    message = np.zeros((len(source), LABELS))
    total = unary.copy()
    for _ in range(rounds if len(source) else 0):
        out = total[source] - message[back]  # all that the source knows but from the target
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ei,eij->ej", out, factor), 1e-300))
        new -= new.max(axis=1, keepdims=True)
        message = damping * message + (1 - damping) * new
        total = unary.copy()
        np.add.at(total, target, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True) if n else p


def added_spans(texts: list[str], tokens: Tokens, field: Field, least: float) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of runs of touching tokens outside base spans whose common label reaches ``least``."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(tokens.labels):
        return out
    p = marginals(tokens, field)
    label = p.argmax(axis=1)
    label[(tokens.labels > 0) | (p.max(axis=1) < least)] = 0
    joined = set(tokens.near[:, 1].tolist())
    for n in np.flatnonzero(label).tolist():
        d, start, end = tokens.place[n]
        kind = int(label[n]) - 1
        if n in joined and label[n - 1] == label[n] and out[d] and out[d][-1][0] == kind:
            out[d][-1] = (kind, out[d][-1][1], end)
        else:
            out[d].append((kind, start, end))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000) -> Field:
    """A field trained on at most ``sample_docs`` documents with a digit or an at sign, chosen by the hash of their ids."""
    some = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("id"))
    chosen = some.orderBy(F.xxhash64("id"), "id").limit(sample_docs).distinct()
    # sample_docs ids bound the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in byte_values(batch.column(1)):
                t = Tokens([text.decode()])
                skip = np.column_stack((t.labels[t.skip[:, :2]], t.skip[:, 2])) if len(t.skip) else t.skip
                out.append([x.astype(np.int32).tobytes() for x in (t.features, t.labels, t.labels[t.near] if len(t.near) else t.near, skip)])
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=["id", "f", "l", "n", "s"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: r[1:])  # one order, however rows arrive
        arrays = [[np.frombuffer(x, np.int32).astype(np.int64).reshape(shape) for x, shape in zip(r[1:], ((-1, Tokens.FEATURES), (-1,), (-1, 2), (-1, 3)), strict=True)] for r in rows]
        field = train([tuple(a) for a in arrays])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (field.token, field.near, field.skip)], names=["token", "near", "skip"])

    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string("f binary, l binary, n binary, s binary").fields])
    got = rows.mapInArrow(look, kind).repartition(1).mapInArrow(solve, "token binary, near binary, skip binary").first()
    return Field(np.frombuffer(got.token, "<f8").reshape(-1, LABELS), np.frombuffer(got.near, "<f8").reshape(LABELS, LABELS), np.frombuffer(got.skip, "<f8").reshape(2, LABELS, LABELS))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """id and spans (kind, start, end in code points, base or added) of every text, by kind, then start.

    Null and empty texts have no spans. Repeated rows each give a row; the field looks at one
    row at a time, so rows that share an id don't mix. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = byte_values(batch.column(1))
            out = []
            for lo, hi in chunks(found):
                texts = [t.decode() for t in found[lo:hi]]
                tokens = Tokens(texts)
                for base, more in zip(tokens.base, added_spans(texts, tokens, shared.value, least), strict=True):
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=[id_col, "spans"])

    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("spans array<struct<kind:string,start:long,end:long,base:boolean>>").fields])
    return docs.select(id_col, text_col).mapInArrow(run, kind)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, from ``find``."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(F.concat_ws(",", F.transform(base, line)).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", line)).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
