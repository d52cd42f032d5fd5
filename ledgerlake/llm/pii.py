"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs
the labelers, and a span classifier learns from the weighed votes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the contract. Where a pattern can only begin at the start
# of a run of digits, it says so, which finds the same places in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SOME = re.compile(r"[0-9@]")

# Candidates that the method may add: looser forms of each kind.
LOOSE_PHONE = re.compile(r"(?<![\w.+-])(?:\(\d{3}\)[\x20-]?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?![\w-])")
LOOSE_CARD = re.compile(r"(?<![\w.+-])\d{4}(?:[\x20.-]\d{4}){3}(?![\w-])")
LOOSE_EMAIL = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]+)+", re.I)

# Gazetteers and context words.
GAZETTEER = {
    "email": frozenset("com org net edu gov info io de fr es uk eu".split()),
    "ip": frozenset("10 127 172 192".split()),
    "card": frozenset("34 35 36 37 38 4 51 52 53 54 55 6011 65 22 23 24 25 26 27".split()),
    "phone": frozenset("1 33 34 44 49 7 39 41 43 61 81 86 91".split()),
}
CONTEXT = {
    "email": re.compile(r"\b(mail|e-mail|email|contact|write|mailto)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|client|from)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|payment|cc)\b", re.I),
    "phone": re.compile(r"\b(tel|phone|call|mobile|fax|whatsapp|number)\b", re.I),
}
AGAINST = re.compile(r"\b(version|invoice|order|isbn|serial|example|part|no)\b\W*$", re.I)
WINDOW = 40  # characters before a span that the context labelers see
LABELERS = 4
ROUNDS = 50


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(found: str) -> str:
    return re.sub(r"[^0-9]", "", found)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@ and DOMAIN. Each begins where
    the run before its @ does, or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        else:
            # No match can begin in this run; the next one begins after it.
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and then by start."""
    if not SOME.search(text):
        return []
    spans = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    spans += [("card", m.start(), m.end()) for m in CARD.finditer(text)
              if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return spans


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    if not SOME.search(text) and "at" not in text:
        return []
    found = [("phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
    found += [("card", m.start(), m.end()) for m in LOOSE_CARD.finditer(text)]
    if "[" in text or "(" in text:
        found += [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)]
    return found


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing. The regular
    expression; the gazetteer; the words before the span; its checksum or shape."""
    found, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = digits_of(found)
    if kind == "email":
        known = found.rpartition(".")[2].lower() in GAZETTEER["email"]
        shape = 1 if re.search(r"[A-Za-z]", found) else -1
    elif kind == "ip":
        known = False if found.split(".")[0] in GAZETTEER["ip"] else True
        shape = -1 if found.startswith("0.") else 1
    elif kind == "card":
        known = any(digits.startswith(p) for p in GAZETTEER["card"])
        shape = 1 if luhn(digits) else -1
    else:
        known = any(digits.startswith(p) for p in GAZETTEER["phone"]) if strict else False
        shape = 1 if 10 <= len(digits) <= 13 else -1
    context = -1 if AGAINST.search(before) else 1 if CONTEXT[kind].search(before) else 0
    return (1 if strict else 0, 1 if known else 0, context, shape)


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span: yes or no answers, none of them a vote."""
    found = text[start:end]
    left, right = text[start - 1 : start], text[end : end + 1]
    count = len(digits_of(found))
    return (
        int(left in ("", " ", "\n", "(", ":", "<")), int(right in ("", " ", "\n", ")", ",", ".", ">")),
        int(count >= 10), int(count >= 16), int("@" in found or "at" in found.lower()), int(" " in found or "-" in found),
    )


def candidates(text: str) -> list[tuple]:
    """(kind, start, end, strict, votes, features). Loose ones touch no base span."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken = bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\x01" * (end - start)
    for kind, start, end in loose_spans(text):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\x01" * (end - start)
            out.append((kind, start, end, False))
    return [(k, s, e, strict, votes(text, k, s, e, strict), features(text, k, s, e)) for k, s, e, strict in out]


@dataclass(frozen=True)
class Classifier:
    """P(personal) of a span of each kind: a logistic function of its features."""

    weights: dict[str, tuple[float, ...]]

    def probability(self, kind: str, shown: tuple[int, ...]) -> float:
        weights = self.weights.get(kind)
        if weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-(weights[0] + np.dot(weights[1:], shown)))))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]]) -> tuple[float, np.ndarray, list[float]]:
    """Expectation-maximisation over vote patterns with their counts: the share of personal
    spans, the chance of each labeler's vote (-1, 0, 1) given personal or not, and the
    posterior of each pattern. Starts where votes are right more often than not."""
    seen = np.array([p for p, _ in patterns]) + 1
    counts = np.array([n for _, n in patterns], dtype=float)
    posterior = 1 / (1 + np.exp(-(seen - 1).sum(axis=1).astype(float)))
    for _ in range(ROUNDS):
        share = (counts * posterior).sum() / counts.sum()
        chance = np.ones((2, seen.shape[1], 3))  # one count each beforehand
        chance[1, :, 2] += 1
        chance[0, :, 0] += 1
        for k in range(seen.shape[1]):
            np.add.at(chance[1, k], seen[:, k], counts * posterior)
            np.add.at(chance[0, k], seen[:, k], counts * (1 - posterior))
        chance /= chance.sum(axis=2, keepdims=True)
        logs = np.log(chance)
        each = np.arange(seen.shape[1])
        odds = np.log((share + 1e-9) / (1 - share + 1e-9)) + sum(
            logs[1, k][seen[:, k]] - logs[0, k][seen[:, k]] for k in each)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return float(share), chance, posterior.tolist()


def fitted(shown: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x = np.hstack([np.ones((len(shown), 1)), shown])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - 0.1 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    return tuple(beta.tolist())


def _counter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        counted: dict[tuple, int] = {}
        for text in part.column("text").to_pylist():
            for kind, _, _, _, voted, shown in candidates(text):
                key = (kind, ",".join(map(str, voted)), ",".join(map(str, shown)))
                counted[key] = counted.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in counted], pa.string()) for i in range(3)]
            + [pa.array(list(counted.values()), pa.int64())],
            names=["kind", "votes", "shown", "n"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def trained(docs: DataFrame) -> Classifier:
    """A classifier per kind, from all candidates of all texts. They are counted by votes and
    features, which are few and small: the driver gets at most 3^4 * 2^6 counts per kind."""
    counts = (
        _texts(docs).select("text").mapInArrow(_counter, "kind string, votes string, shown string, n long")
        .groupBy("kind", "votes", "shown").agg(F.sum("n").alias("n")).collect()
    )
    weights = {}
    for kind in KINDS:
        rows = [(tuple(map(int, r.votes.split(","))), tuple(map(int, r.shown.split(","))), r.n)
                for r in sorted(counts, key=str) if r.kind == kind]
        if not rows:
            continue
        _, _, posterior = reliabilities([(v, n) for v, _, n in rows])
        weights[kind] = fitted(
            np.array([s for _, s, _ in rows], dtype=float), np.array(posterior), np.array([n for *_, n in rows], dtype=float))
    return Classifier(weights)


def written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1])))


def report(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row.

    Base spans always stay; a loose candidate is added when the classifier calls it personal.
    Places count code points, ends are exclusive. Null and empty texts have no spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text in part.column("text").to_pylist():
                found = candidates(text)
                base = [c[:3] for c in found if c[3]]
                more = [c[:3] for c in found if not c[3] and classifier.probability(c[0], c[5]) >= 0.5]
                counts = [sum(k == s[0] for s in base) for k in KINDS]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                out.append((*counts, digest, written(base + more), len(more)))
            columns = list(zip(*out)) if out else [()] * (len(names) - 1)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return _texts(docs).mapInArrow(
        scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
