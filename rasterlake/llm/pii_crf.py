"""Operator 3, personal data: base patterns and a skip-chain conditional random field over each document.

Mentions of a document are the base spans (email, ip, card, phone by the contract's patterns, leftmost and non-overlapping
per kind) and candidates beside them: number groups of seven digits or more, some of which may be masked by x or *, addresses written with (at) or [at], and
opaque words (sixteen characters or more, with letters and digits both). A mention is a node with the labels O, email, ip, card, phone, secret.
Its unary potential comes from its shape (digits, plus sign, separators, length, a failed checksum) and its cue (a word for a kind just before it); neighbours in the text share a chain
potential; mentions with the same digits or the same text, at any distance, share a skip potential, and those that are alike (the same last seven digits, or equal where
neither is masked) another. Base mentions keep their kind; loopy sum-product message passing spreads it, and a candidate whose most likely label is a kind, at ``sure`` or more, is added.
Repeats of one key are linked one to the next, so a document with many repeats has as many links as mentions.

All weights are learned by pseudo-likelihood on the whole corpus: each mention with a known label is predicted from its shape, its cue and its neighbours' labels.
Base mentions know theirs; an opaque word behind a cue and = or : is a secret; a candidate that shares no key with a base mention is O; other candidates' labels are unknown.
Equal situations are counted by one aggregation, and the ``MOST`` most frequent ones (there are a few hundred) reach the driver, which fits the weights.

Null and empty texts have no spans; the hash is that of the empty string. Repeated rows give repeated
results, a null doc_id too; no rows give none. Other columns aren't read. Whole texts are scanned, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text

KINDS = ("email", "ip", "card", "phone", "secret")
BASE, LABELS, MOST = 4, 6, 50_000
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![\w.+*])\(?[0-9xX*][\x20().0-9xX*-]{5,}[0-9xX*](?!\w)")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}")
CUE = re.compile(r"(?i)(?:(e-?mail|mailto|correo|courriel)|(\bip\b|address|server|host)|(card|karte|carte|tarjeta|visa)|(phone|\btel|mobil|fax|call|móvil|handy)|(token|secret|passw(?:or)?d|api[_-]?key|\bkey\b|bearer|credential))[\w\x20\"']{0,12}[\x20:=\"']*$")
ASSIGNED = re.compile(r"[:=][\x20\"']*$")
SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{2,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+)+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out, done = [], 0
    if "@" in text:
        # The pattern starts as far left as its class reaches; looking left from each @ finds that start without trying all.
        at = text.find("@")
        while at >= 0:
            if found := DOMAIN.match(text, at):
                start = at
                while start > done and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    out.append((0, start, found.end()))
                    done = found.end()
                    at = done - 1
            else:
                # Nothing left of a failed @ can be matched later, so a long run isn't walked twice.
                done = at + 1
            at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(part := x.lstrip("0")) <= 3 and int(part or "0") <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Mention:
    kind: int  # of the base pattern; -1 for a candidate
    start: int
    end: int
    key: str
    tail: str
    shape: str
    cue: int  # the kind that a word just before names, and 0 for none; kinds count from 1
    seed: bool = False  # a candidate that its cue makes an example of its kind


def _mention(text: str, kind: int, start: int, end: int, form: str) -> Mention:
    value, before = text[start:end], text[max(0, start - 32) : start]
    named = CUE.search(before)
    cue = named.lastindex if named else 0
    if form == "address":
        key = re.sub(r"[\x20]?[(\[](at|dot)[)\]][\x20]?", lambda m: "@" if m[1] == "at" else ".", value).lower()
        return Mention(kind, start, end, key, "", form, cue)
    if form == "opaque":
        mixed_case = any(c.islower() for c in value) and any(c.isupper() for c in value)
        return Mention(kind, start, end, value.lower(), "", f"opaque{min(len(value) // 8, 8)}{'m' * mixed_case}", cue, cue == 5 and ASSIGNED.search(before) is not None)
    masked = re.sub(r"[^0-9xX*]+", "", value).lower().replace("*", "x")
    digits = masked.replace("x", "")
    style = "".join(sorted(set(value) & set(" ().-")))
    fails = kind < 0 and masked == digits and 16 <= len(digits) <= 19 and not luhn(digits)
    return Mention(kind, start, end, masked if kind < 0 else digits, digits[-7:] if len(digits) >= 7 else digits[-4:] if "x" in masked else "", f"{min(len(masked), 20)}{'+' * value.startswith('+')}{'x' * ('x' in masked)}{'!' * fails}{style if len(style) < 2 else 'more'}", cue)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """Base mentions and candidates that don't overlap them or each other, by start."""
    found = [_mention(text, k, a, b, "address" if k == 0 else "number") for k, a, b in base]
    loose = []
    if "at)" in text or "at]" in text:
        loose += [(m.start(), m.end(), "address") for m in SPELLED.finditer(text)]
    digits = DIGIT.search(text) is not None
    for m in NUMBER.finditer(text) if digits else ():
        value = m[0].rstrip(" (.-)") if m[0].count("(") != m[0].count(")") else m[0]
        if len(NOT_DIGIT.sub("", value)) >= (4 if re.search("[xX*]{2}", value) else 7):
            loose.append((m.start(), m.start() + len(value), "number"))
    for m in OPAQUE.finditer(text) if digits else ():
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            loose.append((m.start(), m.end(), "opaque"))
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
    last = -1
    for a, b, form in sorted(loose, key=lambda x: (x[0], -x[1])):
        k = int(np.searchsorted(starts, b)) - 1
        if a >= last and (k < 0 or reach[k] <= a):
            found.append(_mention(text, -1, a, b, form))
            last = b
    return sorted(found, key=lambda m: (m.start, m.end))


def skips(found: list[Mention]) -> list[tuple[int, int, bool]]:
    """Skip links (mention, later mention, whether they are equal or only alike), each to the next such mention."""
    out = []
    for field in ("key", "tail"):
        last: dict[str, int] = {}
        for i, m in enumerate(found):
            if value := getattr(m, field)[-7:] if field == "tail" else m.key:
                if value in last and not (field == "tail" and found[last[value]].key == m.key):
                    out.append((last[value], i, field == "key"))
                last[value] = i
                if field == "tail" and len(m.tail) == 7:
                    last[m.tail[-4:]] = i  # what a mask leaves of it
    return out


@dataclass
class Potentials:
    """Log potentials: unary by shape and by cue, chain (label, next label), and skip weights for equal and for alike mentions."""

    shape: dict[str, np.ndarray]
    cue: np.ndarray
    chain: np.ndarray
    equal: float
    alike: float
    other: np.ndarray  # of a shape that wasn't seen


def known_labels(found: list[Mention]) -> list[int]:
    """0 for O, kinds from 1, -1 where it isn't known."""
    keys = {v for m in found if m.kind >= 0 or m.seed for v in (m.key, m.tail, m.tail[-4:]) if v}
    return [m.kind + 1 if m.kind >= 0 else 5 if m.seed else 0 if m.key not in keys and m.tail not in keys else -1 for m in found]


def situations(text: str) -> Iterator[tuple[str, int]]:
    """(shape, cue, labels before, behind, of equal and of alike mentions; own label) of each mention whose label is known. 6 is no label, 7 several."""
    found = mentions(text, base_spans(text))
    label = known_labels(found)
    linked: list[list[set]] = [[set(), set()] for _ in found]
    for i, j, equal in skips(found):
        for a, b in ((i, j), (j, i)):
            if label[b] >= 0:
                linked[a][not equal].add(label[b])
    one = lambda labels: 6 if not labels else 7 if len(labels) > 1 else next(iter(labels))
    near = lambda k: label[k] if 0 <= k < len(found) and label[k] >= 0 else 6
    for i, m in enumerate(found):
        if label[i] >= 0:
            yield f"{m.shape}|{m.cue}|{near(i - 1)}|{near(i + 1)}|{one(linked[i][0])}|{one(linked[i][1])}", label[i]


def fit(counted: list[tuple[str, int, int]], penalty: float = 0.1, steps: int = 400) -> Potentials:
    """Weights of the largest penalised pseudo-likelihood of counted situations, by gradient steps of adaptive length."""
    split = [s.split("|") for s, _, _ in counted]
    names = sorted({s[0] for s in split})
    index = {n: k for k, n in enumerate(names)}
    shape = np.array([index[s[0]] for s in split], np.int64)
    cue, before, behind, equal, alike = (np.array([int(s[k]) for s in split], np.int64) for k in range(1, 6))
    y, n = np.array([c[1] for c in counted], np.int64), np.array([c[2] for c in counted], float)
    sizes = {"shape": (len(names), LABELS), "cue": (6, LABELS), "chain": (LABELS + 1, LABELS + 1), "bias": (LABELS,), "skip": (2,)}
    w = {k: np.zeros(v) for k, v in sizes.items()}
    first, second = ({k: np.zeros(v) for k, v in sizes.items()} for _ in range(2))
    same = [np.arange(LABELS)[None, :] == v[:, None] for v in (equal, alike)]
    target = np.eye(LABELS)[y] if len(y) else np.zeros((0, LABELS))
    for t in range(1, steps + 1):
        score = w["bias"] + w["shape"][shape] + w["cue"][cue] + w["chain"][before, :LABELS] + w["chain"][:LABELS, :][:, behind].T + w["skip"][0] * same[0] + w["skip"][1] * same[1]
        p = np.exp(score - score.max(1, keepdims=True)) if len(y) else score
        p /= p.sum(1, keepdims=True) if len(y) else 1
        miss = n[:, None] * (target - p)
        slope = {k: -penalty * w[k] for k in w}
        slope["bias"] += miss.sum(0)
        np.add.at(slope["shape"], shape, miss)
        np.add.at(slope["cue"], cue, miss)
        np.add.at(slope["chain"][:, :LABELS], before, miss)
        np.add.at(slope["chain"][:LABELS, :].T, behind, miss)
        slope["skip"] += [(miss * s).sum() for s in same]
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            w[k] += 0.1 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Potentials({k: w["bias"] + w["shape"][i] for k, i in index.items()}, w["cue"], w["chain"][:LABELS, :LABELS], float(max(w["skip"][0], 0)), float(max(w["skip"][1], 0)), w["bias"])


def train(docs: DataFrame) -> Potentials:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(situations(text.as_py()))
        what = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in what], pa.string()), pa.array([k for _, k in what], pa.int32()), pa.array([total[w] for w in what], pa.int64())], ["what", "label", "n"])

    rows = id_text(docs).select("text").mapInArrow(count, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "what", "label").limit(MOST).collect()
    return fit([(r["what"], r["label"], r["n"]) for r in rows])


def label_mentions(found: list[Mention], p: Potentials, rounds: int = 12) -> np.ndarray:
    """Marginals (mentions x labels) by loopy sum-product message passing with damping; base mentions are clamped."""
    unary = np.array([p.shape.get(m.shape, p.other) + p.cue[m.cue] for m in found])
    for i, m in enumerate(found):
        if m.kind >= 0:
            unary[i] = -30.0
            unary[i, m.kind + 1] = 0.0
    links = [(i, i + 1, p.chain) for i in range(len(found) - 1)] + [(i, j, np.eye(LABELS) * (p.equal if equal else p.alike)) for i, j, equal in skips(found)]
    total = unary.copy()
    if links:
        source, target, table = zip(*links, strict=True)
        a, b = np.array(source + target), np.array(target + source)
        t = np.array([*table, *(x.T for x in table)])
        back = np.concatenate([np.arange(len(source)) + len(source), np.arange(len(source))])
        message = np.zeros((len(a), LABELS))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, b, message)
            out = (total[a] - message[back])[:, :, None] + t
            top = out.max(1, keepdims=True)
            out = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0, :]
            message = 0.5 * message + 0.5 * (out - out.max(1, keepdims=True))
        total = unary.copy()
        np.add.at(total, b, message)
    q = np.exp(total - total.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def all_spans(text: str, p: Potentials, sure: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans, both by kind and start."""
    base = base_spans(text)
    found = mentions(text, base)
    if len(found) == len(base):
        return base, base
    q = label_mentions(found, p)
    added = [(int(q[i].argmax()) - 1, m.start, m.end) for i, m in enumerate(found) if m.kind < 0 and q[i].argmax() > 0 and q[i].max() >= sure]
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, potentials: Potentials | None = None, sure: float = 0.6) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    p = potentials or train(docs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py(), p, sure)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(BASE)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(spans) - len(base)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * BASE + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_added"])

    return id_text(docs).mapInArrow(search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, potentials: Potentials | None = None, sure: float = 0.6, text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with personal data replaced in the text; a null text stays null. No shuffle."""
    p = potentials or train(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    at = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (text := t.as_py()) is None else redact(text, all_spans(text, p, sure)[1]) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)
