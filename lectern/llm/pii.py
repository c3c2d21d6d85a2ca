"""Personal data by a skip-chain conditional random field over rule matches.

Rules find the base spans (email, ip, card, phone); a fifth rule finds what is
assigned to a word like "token" or "password" (secret). The nodes of a
document's field are those matches as wholes, with labels that are known, and
the other entity-like stretches outside them: tokens with a digit or an at sign,
tokens that equal a part of a match, and runs of tokens whose digits together
are those of a match. Labels are none and the five kinds. Three sorts of
potentials tell them:

- of a node's shape (digits, signs, check sums, the word before it), by a softmax
  regression on the rules' labels;
- of neighbouring nodes, by smoothed counts of neighbouring labels;
- of nodes linked by a skip: with the same key (text, digits, mail name), with
  keys one edit apart, or where one key is the other without its first digits
  (a number without its country code). Each sort of link has a weight, the log
  odds that such nodes agree, from counts among rule matches on top of a prior.

Loopy sum-product messages run until they settle; a node whose most probable
label isn't none becomes a further span. So a number that the rules miss by its
check sum alone is refused by its shape, and added where the same number, or
nearly, is a rule's match elsewhere in the document. Nodes are linked to the
first match that has their key, or where none has it to its first node; links one
edit apart or by ending go to one match each. So links are linear in a text's
length, and messages have a short way.

Potentials are fitted on a bounded sample (the first `fit_texts` by hash of the
texts with a digit or an at sign among about `fit_rows` documents), and on a
near miss of each rule match, which no rule accepts.

Defined results: null or empty texts have no spans; repeated rows give repeated
results; extra columns are ignored by `find_pii` and kept by `redact`; an empty
table gives an empty result and a fit of the near misses alone. One Arrow batch
and one document's nodes bound the memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, map_batches

#: The first four are the base; the method adds spans of these and of the last.
KINDS = ("email", "ip", "card", "phone", "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only and never given back: a later start or a shorter run can't match either.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACE_RUN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_EDGE = re.compile(r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, 0, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the rules find: leftmost and non-overlapping for each kind, by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the field

#: Words that what they are assigned is a secret, and the least length of one.
CUES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "credential", "bearer")
SECRET_CHARS = 16
_CUE = re.compile(r"(?:" + "|".join(CUES) + r")[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?", re.IGNORECASE)
_SECRET = re.compile(r"[A-Za-z0-9_/+-]++")


def secret_spans(text: str) -> list[Span]:
    """What is assigned to a cue word, if it is long and has letters and digits."""
    out, done = [], 0
    for cue in _CUE.finditer(text):
        m = _SECRET.match(text, cue.end())
        if m and m.start() >= done and len(m[0]) >= SECRET_CHARS and _DIGIT.search(m[0]) and any(map(str.isalpha, m[0])):
            out.append((m.start(), 4, m.end()))
            done = m.end()
    return out


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def _keys(token: str) -> list[str]:
    """What nodes are linked by: the text, its digits, its mail name. Short forms are no keys."""
    low, digits = token.lower(), _digits(token)
    name = low.partition("@")[0]
    return [*(["t" + low] if len(low) >= 5 else []), *(["d" + digits] if len(digits) >= 7 else []), *(["t" + name] if name != low and len(name) >= 5 else [])]


def _one_edit(key: str) -> list[str]:
    """The key without each of its characters in turn: two keys of one length that share one differ in one place at most. Long or short keys have none."""
    return [f"{i} {key[:i]}{key[i + 1 :]}" for i in range(1, len(key))] if 8 <= len(key) <= 40 else []


def _mixed(token: str) -> bool:
    return len(token) >= SECRET_CHARS and _DIGIT.search(token) is not None and any(map(str.isalpha, token))


def _valid_ip(token: str) -> bool:
    parts = token.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _shape(token: str) -> tuple[int, ...]:
    digits = _digits(token)
    name, at, host = token.partition("@")
    return (
        0,
        1 + min(len(digits), 20),
        22 + (0 if not at else 1 if name and "." in host.strip(".") else 2),
        25 + min(token.count("."), 4),
        30 + (token[:1] == "+"),
        32 + (any(map(str.isalpha, token))),
        34 + ("-" in token),
        36 + (14 <= len(digits) <= 19 and luhn(digits)),
        38 + _valid_ip(token),
        40 + _mixed(token),
    )


N_FEATURES, N_LABELS = 42, 1 + len(KINDS)
#: Sorts of skip links, and before any is seen: how many agreed, how many didn't.
LINKS = ("same", "one edit", "ending")
PRIOR = ((20.0, 0.1), (6.0, 0.5), (20.0, 0.2))


class Nodes:
    """The nodes, links and rule labels of one document."""

    def __init__(self, text: str, base: list[Span], secrets: list[Span] | None = None):
        known = sorted([*base, *(x for x in secrets or [] if not any(x[0] < e and s < x[2] for s, _, e in base))]) if secrets else base
        self.at: list[tuple[int, int]] = [(s, e) for s, _, e in known]
        self.label: list[int] = [k + 1 for _, k, _ in known]
        said = [text[s:e] for s, e in self.at]
        parts, whole = set(), set()
        for x in said:
            parts |= {k for word in _SPACE_RUN.findall(x) for k in _keys(_EDGE.sub("", word)) if k[0] == "t"}
            if len(d := _digits(x)) >= 7:
                whole |= {d[i:] for i in range(min(4, len(d) - 6))}
        starts, ends = [s for s, _ in self.at], sorted(e for _, e in self.at)
        # tokens outside of matches: (place among all tokens, start, end)
        free: list[tuple[int, int, int]] = []
        for i, m in enumerate(_SPACE_RUN.finditer(text)):
            raw = m[0]
            token = _EDGE.sub("", raw)
            if not token or not _DIGIT.search(raw) and "@" not in raw and "t" + token.lower() not in parts:
                continue
            s = m.start() + raw.find(token)
            if bisect_left(starts, s + len(token)) <= bisect_right(ends, s):  # overlaps no match
                free.append((i, s, s + len(token)))
        chain = []
        at, previous = 0, -2
        while at < len(free):
            took = 1
            # a few tokens in a row whose digits together are a match's
            digits = _digits(text[free[at][1] : free[at][2]]) if whole else ""
            for n in range(2, 7):
                if not whole or at + n > len(free) or free[at + n - 1][0] != free[at][0] + n - 1 or len(digits) > 19:
                    break
                digits += _digits(text[free[at + n - 1][1] : free[at + n - 1][2]])
                if digits in whole and not any(map(str.isalpha, text[free[at][1] : free[at + n - 1][2]])):
                    took = n
            s, e = free[at][1], free[at + took - 1][2]
            if previous == free[at][0] - 1:
                chain.append((len(self.at) - 1, len(self.at)))
            previous = free[at + took - 1][0]
            self.at.append((s, e))
            self.label.append(0)
            said.append(text[s:e])
            at += took
        self.chain = chain
        self.shape = [_shape(x) for x in said]
        self.skip: list[tuple[int, int, int]] = self._links([_keys(x) for x in said])

    def _links(self, keys: list[list[str]]) -> list[tuple[int, int, int]]:
        """(node, node, sort) of all skip links; at most one for each key and sort of a node."""
        first: dict[str, int] = {}
        near: dict[str, int] = {}
        ending: dict[str, int] = {}
        out: set[tuple[int, int, int]] = set()
        matches = [i for i, k in enumerate(self.label) if k]
        for i in matches:
            for k in keys[i]:
                if k in first:
                    out.add((first[k], i, 0))
                    continue
                for x in _one_edit(k):
                    if x in near:
                        out.add((near[x], i, 1))
                        break
                first[k] = i
                for x in _one_edit(k):
                    near.setdefault(x, i)
                if k[0] == "d":
                    if k in ending:
                        out.add((ending[k], i, 2))
                    for n in range(1, min(4, len(k) - 7)):
                        ending.setdefault("d" + k[1 + n :], i)
        other: dict[str, int] = {}
        for i in range(len(matches), len(keys)):
            for k in keys[i]:
                if k in first:
                    out.add((first[k], i, 0))
                    continue
                if k in other:
                    out.add((other[k], i, 0))
                other.setdefault(k, i)
                if (j := next((near[x] for x in _one_edit(k) if x in near), None)) is not None:
                    out.add((j, i, 1))
                if k[0] == "d":
                    if (j := ending.get(k)) is None:
                        j = next((first[x] for n in range(1, min(4, len(k) - 7)) if (x := "d" + k[1 + n :]) in first), None)
                    if j is not None:
                        out.add((j, i, 2))
        return sorted(out)


def _near_miss(span: str, kind: int) -> str:
    """A text much like a match that its rule doesn't accept."""
    if kind == 0:
        return span.replace("@", " at ", 1).split()[-1]
    if kind == 1:
        return ".".join(["999", *span.split(".")[1:]])
    if kind == 2:
        return span[:-1] + str((int(span[-1]) + 1) % 10)
    return span.lstrip("+")


class Field:
    """Potentials of the field."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, np.asarray(skip, float)

    @classmethod
    def fit(cls, documents: list[str], steps: int = 300) -> Field:
        """Softmax regression on shapes, smoothed label pairs, and agreement of linked nodes that rules label."""
        shapes, pairs, seen = [], np.ones((N_LABELS, N_LABELS)), np.array(PRIOR)
        for text in [*documents, "ab@cd.example 10.0.0.1 4587121519400672 +1 555 555 0100 token = a1b2c3d4e5f6a7b8c9 version 2.0 of 1999"]:
            base = base_spans(text)
            n = Nodes(text, base, secret_spans(text))
            shapes += [(*f, k, k) for f, k in zip(n.shape, n.label, strict=True)]
            shapes += [(*_shape(_near_miss(text[s:e], k)), 0, N_LABELS + k) for s, k, e in base]
            # a secret's shape alone, without the word before it, is no secret more often than not
            shapes += [(*f, 0, 2 * N_LABELS) for f, k in zip(n.shape, n.label, strict=True) if k == 5]
            for i, j in n.chain:
                pairs[n.label[i], n.label[j]] += 1
            for i, j, sort in n.skip:
                if n.label[i] and n.label[j]:
                    seen[sort, int(n.label[i] != n.label[j])] += 1
        unary = np.zeros((N_FEATURES, N_LABELS))
        # equal shapes count once, with their number; every label weighs alike, and its near misses as much (a
        # secret's twice): how common a label is says nothing about a node that is linked to a match
        x, n = np.unique(np.array(shapes), axis=0, return_counts=True)
        group = x[:, -1]
        n = n / np.bincount(group, n, 2 * N_LABELS + 1)[group] * np.where(group == 2 * N_LABELS, 2, 1)
        y, share, design = np.eye(N_LABELS)[x[:, -2]], (n / n.sum())[:, None], np.zeros((len(x), N_FEATURES))
        np.put_along_axis(design, x[:, :-2], 1, axis=1)
        for _ in range(steps):
            z = design @ unary
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            unary -= 2.0 * (design.T @ ((p - y) * share) + 1e-3 * unary)
        rows = np.log(pairs / pairs.sum(1, keepdims=True))
        against = np.log(pairs.sum(0) / pairs.sum())
        return cls(unary, np.clip(rows - against, -2, 2), np.log(seen[:, 0] / seen[:, 1] * (N_LABELS - 1)))

    def marginals(self, n: Nodes, rounds: int = 1000, settled: float = 1e-4) -> np.ndarray:
        """Loopy sum-product messages in the log domain, all at once in each round, damped by half.

        They run until none changes by more than `settled`; `rounds` only ends those that never do.
        """
        node = np.array([self.unary[list(f)].sum(0) for f in n.shape])
        node -= node.max(1, keepdims=True)
        fixed = np.array(n.label)
        edges = [*n.chain, *((i, j) for i, j, _ in n.skip)]
        if edges:
            potential = np.concatenate([np.stack([self.chain] * len(n.chain)) if n.chain else np.zeros((0, N_LABELS, N_LABELS)), np.eye(N_LABELS)[None] * self.skip[[k for _, _, k in n.skip]][:, None, None]])
            a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
            # what a rule labels is known: it tells its neighbours once, and nothing outvotes it
            for x, y, table in ((a, b, potential), (b, a, potential.transpose(0, 2, 1))):
                known = (fixed[x] > 0) & (fixed[y] == 0)
                np.add.at(node, y[known], table[known, fixed[x[known]]])
            free = (fixed[a] == 0) & (fixed[b] == 0)
            a, b, potential = a[free], b[free], potential[free]
        node[fixed > 0] = np.where(np.eye(N_LABELS, dtype=bool)[fixed[fixed > 0]], 0.0, -np.inf)
        if not edges or not len(a):
            return _normal(node)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(src), N_LABELS))
        for _ in range(rounds):
            total = node.copy()
            np.add.at(total, dst, message)
            held = total[src] - message[back]
            new = _logsum(held[:, :, None] + table)
            new -= _logsum(new[:, :, None])
            new = 0.5 * message + 0.5 * new
            change = np.abs(new - message).max()
            message = new
            if change <= settled:
                break
        total = node.copy()
        np.add.at(total, dst, message)
        return _normal(total)

    def further(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beyond the base: secrets that their rule finds, and nodes whose best label isn't none."""
        if not _DIGIT.search(text) and "@" not in text:
            return []
        n = Nodes(text, base, secret_spans(text))
        if len(n.label) == len(base):
            return []
        best = self.marginals(n).argmax(1)
        return [(s, int(k) - 1, e) for (s, e), k, known in zip(n.at, best, n.label, strict=True) if k and (not known or known == 5)]


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]


def _normal(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


# --- DataFrames


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, fit_texts: int = 2000, fit_chars: int = 20_000) -> Field:
    """The field's potentials from texts with a digit or an at sign: the first fit_texts by hash among those of about fit_rows rows, chosen by hash of their id.

    Texts of more than fit_chars characters are left out of the fit.
    """
    rows = (
        docs.where(hash_share(id_col, fit_rows, docs.count()))
        .select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
        .where((F.length("text") <= fit_chars) & F.col("text").rlike("[0-9@]"))
        .orderBy("h", "text")
        .limit(fit_texts)
        .collect()
    )
    return Field.fit(sorted(r.text for r in rows))


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + field.further(text, base))


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and list of the base spans and the further spans of every whole text.

    n_email to n_phone count base spans, n_added further ones, n_spans all; places are code points, ends exclusive.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text in b.column(1).to_pylist():
                base, full = spans_of(text or "", field)
                n = [sum(x[1] == k for x in base) for k in range(4)]
                rows.append((*n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(full), len(full) - len(base), len(full)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), batches, SCHEMA)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span, or each run of overlapping spans, becomes the name of its first kind in angle brackets."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; a null text stays null."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [t if t is None else redact_text(t, spans_of(t, field)[1]) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == place else c for i, c in enumerate(b.columns)], b.schema.names)

    return map_batches(docs, batches, schema)
