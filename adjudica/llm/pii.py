"""Operator 1, personal data: fixed patterns plus a skip-chain CRF.

Fixed patterns give email, ip, card and phone spans. Every other token with a
digit or an at-sign becomes a node of a conditional random field, as do the
fixed spans, whose labels are clamped. Neighbouring nodes share a chain edge.
Nodes with the same folded text, however far apart, share a skip edge (each
occurrence with the next one, so a text with n repeats has n - 1 skip edges and
never n squared), and so do nodes of one stem, the same letters before the first
digit. What the context of any occurrence shows, say ``password=``, counts for all
occurrences of that string in the document, so that it does not fade over bare
repeats, however many there are. Loopy sum-product passing over all documents of a
batch runs until its messages settle.

Weights of a string's own shape, of chain edges and of skip edges are trained by
pseudo-likelihood on some ``SAMPLE_DOCS`` whole documents, drawn by a hash of the row,
in one task. Labels to train on come from the fixed patterns and from assignments to
credential words. Those words are no trained feature, as a label must not explain
itself: in use, they add the fixed potential ``CUE_POTENTIAL``.

Defined results: null or empty text gives no spans and the digest of the empty
string; texts are read whole, at a cost linear in their length; ties and repeated
rows are scored alike, each row for itself; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Expected size of the training sample, in documents.
SAMPLE_DOCS = 600
#: Log-odds that an assignment to a credential word gives.
CUE_POTENTIAL = 8.0

#: A message that moves by less than this, in log units, rests.
SETTLED = 1e-5

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS, "secret"]
# Words whose assignment marks a credential.
CREDENTIAL_WORDS = ["token", "password", "passwd", "secret", "apikey", "api_key", "key", "pwd"]

SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string, n_secret long, n_spans long"
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts: what fails at the run's start fails inside it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs between separators; those with a digit or an at-sign become nodes.
RUN = re.compile(r"[^\s\"'=<>,;(){}\[\]]+")
MARKED = re.compile(r"[0-9@]")
CUE = re.compile(r"([A-Za-z_]+)[\s\"'=:]{1,6}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses, by at-sign: linear also in long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def nodes(text: str, base: list[tuple[int, int, str]]):
    """Rows of the random field: (start, end, clamped label or 0, folded text, features)."""
    out = [(a, b, k + 1, text[a:b].lower(), ()) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    i = 0
    for m in RUN.finditer(text) if MARKED.search(text) else ():
        a, b = m.start(), m.end()
        if not MARKED.search(text, a, b):
            continue
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a == b or any(x < b for x, _ in taken[i : i + 1]):
            continue
        out.append((a, b, 0, text[a:b].lower(), features(text, a, b)))
    return sorted(out)


def cue(text: str, a: int) -> tuple[str, bool]:
    before = text[max(0, a - 24) : a]
    m = CUE.search(before)
    return (m[1].lower() if m else "", "=" in before[-4:] or ":" in before[-4:])


FEATURES = ["bias", "at", "digits_only", "hex", "mixed", "dots", "long", "middle", "short", "quoted", "hex_long"]
HEX = frozenset("0123456789abcdef")


def features(text: str, a: int, b: int) -> tuple:
    """FEATURES of a string, and whether it is assigned to a credential word."""
    token = text[a:b]
    n, digits = b - a, sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    hexa = n >= 8 and not set(token.lower()) - HEX
    word, assigned = cue(text, a)
    quoted = a > 0 and text[a - 1] in "\"'"
    return (
        1, "@" in token, digits == n, hexa, digits > 0 and letters > 0, token.count(".") >= 2,
        n >= 16, 8 <= n < 16, n < 8, quoted, hexa and n >= 16, word in CREDENTIAL_WORDS and assigned and n >= 8,
    )


def stem(folded: str) -> str:
    """Letters and signs before the first digit, if they are many enough to tell strings apart."""
    m = MARKED.search(folded)
    return folded[: m.start()] if m and m.start() >= 4 else ""


def pooled(field: list[tuple]) -> list[tuple]:
    """A document's nodes, free ones with the features that any free node of the same folded text has."""
    shared: dict[str, tuple] = {}
    for row in field:
        if row[4]:
            known = shared.get(row[3])
            shared[row[3]] = tuple(map(max, known, row[4])) if known else row[4]
    return [(*row[:4], shared[row[3]]) if row[4] else row for row in field]


def edges(field: list[tuple], first: int) -> tuple[list, list]:
    """Chain and skip edges of one document's nodes, numbered from ``first``."""
    chain = [(first + i, first + i + 1) for i in range(len(field) - 1) if field[i + 1][0] - field[i][1] <= 40]
    last: dict[tuple[str, str], int] = {}
    skip = []
    for i, row in enumerate(field):
        for key in (("same", row[3]), ("stem", stem(row[3]) if row[4] else "")):
            before = last.get(key, -1) if key[1] else -1
            # Neighbours in the chain, or the same string again, need no second edge.
            if before >= 0 and (key[0] == "same" or field[before][3] != row[3]):
                skip.append((first + before, first + i))
            last[key] = i
    return chain, skip


def train(texts: list[str]) -> dict[str, np.ndarray]:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels."""
    k = len(LABELS)
    x, y, chains, skips = [], [], [], []
    for text in texts:
        field = pooled(nodes(text, base_spans(text)))
        c, s = edges(field, len(x))
        for a, b, clamped, _, f in field:
            x.append((f or features(text, a, b))[:-1])
            y.append(clamped or (LABELS.index("secret") if f[-1] else 0))
        chains += c
        skips += s
    weights = {"x": np.zeros((len(FEATURES), k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    weights["x"][0, 0] = 2.0
    weights["skip"] += 2.0 * np.eye(k)
    if not x:
        return weights
    x, y = np.array(x, float), np.array(y)
    hot = np.eye(k)[y]

    def gathered(pairs: list) -> np.ndarray:
        out = np.zeros((len(y), k))
        if pairs:
            i, j = np.array(pairs).T
            np.add.at(out, i, hot[j])
            np.add.at(out, j, hot[i])
        return out

    near, far = gathered(chains), gathered(skips)
    speed = {n: np.zeros_like(w) for n, w in weights.items()}
    for _ in range(150):
        z = x @ weights["x"] + near @ weights["chain"] + far @ weights["skip"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        e = (hot - p) / len(y)
        for name, inputs in (("x", x), ("chain", near), ("skip", far)):
            step = inputs.T @ e - 1e-4 * weights[name]
            if name != "x":
                step = (step + step.T) / 2
            speed[name] = 0.9 * speed[name] + step
            weights[name] = weights[name] + 2.0 * speed[name]
    # Repeats must not push labels apart, whatever a small sample says.
    weights["skip"] = np.maximum(weights["skip"], 1.0 * np.eye(k))
    return weights


def infer(unary: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], rounds: int | None = None) -> np.ndarray:
    """Damped loopy sum-product in the log domain over all edges at once; label by node.

    Runs until no message moves by SETTLED; edges whose surroundings rest are left
    out. ``rounds`` bounds loops that never settle: by default enough for news to
    cross all nodes four times over.
    """
    n, k = unary.shape
    ends = [(np.asarray(e, int).reshape(-1, 2), w) for e, w in pairs if len(e)]
    if not ends:
        return unary.argmax(1)
    src = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in ends])
    dst = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in ends])
    kind = np.concatenate([np.full(2 * len(e), i) for i, (e, _) in enumerate(ends)])
    weights = np.stack([w for _, w in ends])
    back, at = np.empty(len(src), int), 0
    for e, _ in ends:
        m = len(e)
        back[at : at + m], back[at + m : at + 2 * m] = np.arange(at + m, at + 2 * m), np.arange(at, at + m)
        at += 2 * m
    leaving = np.argsort(src, kind="stable")
    first = np.searchsorted(src[leaving], np.arange(n + 1))
    messages = np.zeros((len(src), k))
    belief = unary.astype(float)
    active = np.arange(len(src))
    for _ in range(100 + 4 * n if rounds is None else rounds):
        inner = (belief[src[active]] - messages[back[active]])[:, :, None] + weights[kind[active]]
        top = inner.max(1)
        new = np.log(np.exp(inner - top[:, None, :]).sum(1)) + top
        new -= new.max(1, keepdims=True)
        step = 0.5 * (new - messages[active])
        messages[active] += step
        np.add.at(belief, dst[active], step)
        moving = active[np.abs(step).max(1) > SETTLED]
        if not len(moving):
            break
        # A moved message concerns itself, as it is damped, and what leaves the node it goes to.
        told = np.unique(dst[moving])
        sizes = first[told + 1] - first[told]
        onward = leaving[np.repeat(first[told] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        active = np.unique(np.concatenate([moving, onward]))
    return belief.argmax(1)


def label(texts: list[str], weights: dict[str, np.ndarray]):
    """For each text: base spans, and all spans with those the random field adds."""
    k, bases, fields = len(LABELS), [], []
    unary, chains, skips, first = [], [], [], 0
    for text in texts:
        base = base_spans(text)
        field = pooled(nodes(text, base))
        c, s = edges(field, first)
        bases.append(base)
        fields.append(field)
        chains += c
        skips += s
        first += len(field)
        unary += [row[4] if row[4] else (0,) * (len(FEATURES) + 1) for row in field]
    if first:
        clamped = np.array([row[2] for field in fields for row in field])
        seen = np.array(unary, float)
        z = seen[:, :-1] @ weights["x"]
        z[:, LABELS.index("secret")] += CUE_POTENTIAL * seen[:, -1]
        # The fixed patterns know every valid number: what they left may be an unusual address or a secret.
        z[:, [LABELS.index(x) for x in ("ip", "card", "phone")]] = -50.0
        z[seen[:, FEATURES.index("at")] == 0, LABELS.index("email")] = -50.0
        fixed = clamped > 0
        z[fixed] = np.where(np.arange(k) == clamped[fixed][:, None], 0.0, -50.0)
        labels = infer(z, [(chains, weights["chain"]), (skips, weights["skip"])])
    at = 0
    for base, field in zip(bases, fields, strict=True):
        own = labels[at : at + len(field)] if field else []
        at += len(field)
        spans = [(a, k, b) for a, k, b in base]
        spans += [(a, int(y) - 1, b) for (a, b, c, _, _), y in zip(field, own, strict=True) if y and not c]
        yield base, sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k + 1]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(documents: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Spans of personal data in every whole text; see the module's text for the method."""
    if weights is None:
        weights = fit(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches):
        for pdf in batches:
            rows = []
            # Few texts at a time keep the random field's arrays small.
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                texts = ["" if t is None else t for t in part["text"]]
                for doc_id, (base, spans) in zip(part["doc_id"], label(texts, weights), strict=True):
                    n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append((None if pd.isna(doc_id) else int(doc_id), *n, digest, joined(spans), sum(k == 4 for _, k, _ in spans), len(spans)))
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans"]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    return docs.mapInPandas(scan, SCHEMA)


def fit(documents: DataFrame) -> dict[str, np.ndarray]:
    """Train the weights on some SAMPLE_DOCS documents with a digit or an at-sign.

    Rows are drawn one by one by hash; only the drawn ones travel, to a single task,
    and the driver gets the weights alone.
    """
    marked = documents.where(F.col("text").rlike("[0-9@]"))
    n = marked.count()
    reach = min(2**62, math.ceil(2**62 * SAMPLE_DOCS / max(n, 1)))
    drawn = marked.where(F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)) < reach)

    def scan(batches):
        texts = sorted(t for pdf in batches for t in pdf["text"])
        for name, w in train(texts).items():
            yield pd.DataFrame({"name": name, "row": range(len(w)), "values": [list(map(float, r)) for r in w]})

    rows = drawn.select(F.col("text").cast("string").alias("text")).repartition(1).mapInPandas(scan, "name string, row int, values array<double>").collect()
    if not rows:
        return train([])
    return {name: np.array([r["values"] for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["row"])]) for name in ("x", "chain", "skip")}
