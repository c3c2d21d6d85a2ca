"""License scan: Aho-Corasick for notice phrases and identifier tags, shunting-yard for expressions.

Every text becomes a line of lower-cased words, over which one automaton finds
all notice phrases in a single pass. A second automaton finds identifier tags in
the raw text; what follows a tag is parsed as an and/or/with expression. So is
what follows words such as "licensed under": names of licences there, as prose
writes them, become identifiers first.

Defined results: a null or empty text has no words, no labels and score 0; a row
that occurs twice is scanned twice; extra columns are ignored; an empty table
gives an empty result. Places of one phrase may overlap those of another and all
count. Memory is bounded by one Arrow batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases of our own, beside the base.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu affero general public license": "agpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifier of an expression (any version suffix after it): label, and whether it is permissive.
IDENTIFIERS = {
    "mit": ("mit", True),
    "apache-2": ("apache-2", True),
    "bsd": ("bsd", True),
    "isc": ("isc", True),
    "unlicense": ("unlicense", True),
    "cc0": ("cc0", True),
    "cc-by-nc": ("cc-by-nc", False),
    "cc-by-sa": ("cc-by-sa", False),
    "cc-by": ("cc-by", True),
    "gpl-2": ("gpl-2", False),
    "gpl-3": ("gpl-3", False),
    "lgpl": ("lgpl", False),
    "agpl-3": ("agpl-3", False),
    "mpl-2": ("mpl-2", False),
}
#: Words that a licence's name, or an expression of several, follows in prose; names as words, longest first; words passed over.
PROSE = ("licensed under", "released under", "distributed under", "available under")
NAMES = {
    ("gnu", "lesser", "general", "public"): "lgpl",
    ("gnu", "affero", "general", "public"): "agpl-3",
    ("gnu", "general", "public"): "gpl",
    ("mozilla", "public"): "mpl-2",
    ("cc", "by", "nc"): "cc-by-nc",
    ("cc", "by", "sa"): "cc-by-sa",
    ("cc", "by"): "cc-by",
    ("apache",): "apache-2",
    ("mit",): "mit",
    ("bsd",): "bsd",
    ("isc",): "isc",
    ("cc0",): "cc0",
    ("unlicense",): "unlicense",
}
FILLERS = {"the", "a", "an", "either", "both", "terms", "of", "license", "licence", "licenses", "version", "v", "clause", *"0123456789"}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expression string, permissive boolean"
)

_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?)")
_RANK = {"or": 1, "and": 2, "with": 3}


def _identifier(token: str) -> tuple[str, bool] | None:
    for name in sorted(IDENTIFIERS, key=len, reverse=True):
        if token == name or token.startswith(name) and token[len(name)] in ".-+":
            return IDENTIFIERS[name]
    return None


def _apply(op: str, right: dict, left: dict) -> dict:
    if op == "with":  # an exception widens what the licence allows and is none itself
        return left
    known = [x["permissive"] for x in (left, right) if x["permissive"] is not None]
    if op == "or":
        verdict = True if True in known else None if len(known) < 2 else False
    else:
        verdict = False if False in known else None if len(known) < 2 else True
    return {"labels": left["labels"] | right["labels"], "permissive": verdict}


def parse_expression(text: str, at: int = 0) -> tuple[str, dict] | None:
    """The longest licence expression of a lower-cased text from a place on, up to the line's end.

    Shunting-yard with one stack of operators and one of values; `with` binds
    before `and`, `and` before `or`. Returns the expression as written and its
    value ({labels, permissive}), or None where none starts there. Where an
    expression breaks off, what stands before the break counts.
    """
    values: list[dict] = []
    ops: list[str] = []
    start, end, operand_next = at, at, True
    pending_end = at  # where the text ends if the operator just read gets no operand

    def reduce(rank: int) -> None:
        while ops and ops[-1] != "(" and _RANK[ops[-1]] >= rank:
            values.append(_apply(ops.pop(), values.pop(), values.pop()))

    while m := _TOKEN.match(text, end):
        token = m[1]
        if operand_next:
            if token == "(":
                ops.append(token)
            elif token == ")" or token in _RANK:
                break
            else:
                found = _identifier(token)
                values.append({"labels": {found[0]} if found else set(), "permissive": found[1] if found else None})
                operand_next, pending_end = False, m.end()
        elif token in _RANK:
            reduce(_RANK[token])
            ops.append(token)
            operand_next = True
        elif token == ")" and "(" in ops:
            reduce(0)
            ops.pop()
            pending_end = m.end()
        else:
            break
        end = m.end()
    if not values:
        return None
    if operand_next:  # drop operators and brackets that got no operand
        while ops and (ops[-1] == "(" or len(values) < 1 + sum(x != "(" for x in ops)):
            ops.pop()
    ops = [x for x in ops if x != "("]
    while ops:
        values.append(_apply(ops.pop(), values.pop(), values.pop()))
    return text[start:pending_end].strip(), values[-1]


def prose_expression(line: str, at: int) -> str | None:
    """What stands from a place of a line of words on, as an expression of identifiers, up to the first word that is none of a licence's."""
    out: list[str] = []
    ahead: list[str] = []  # words read but not taken

    def word(i: int) -> str:
        nonlocal at
        while len(ahead) <= i:
            end = line.find(" ", at)
            ahead.append(line[at:end] if end > at else "")
            at = end + 1 if end > at else len(line)
        return ahead[i]

    while word(0):
        name = next((n for n in NAMES if all(word(i) == x for i, x in enumerate(n))), None)
        if name:
            del ahead[: len(name)]
            told = NAMES[name]
            if told == "gpl":  # its version follows, or it is the later one
                told = "gpl-2" if "2" in (follows := [word(i) for i in range(3)]) and "3" not in follows else "gpl-3"
            out.append(told)
        elif word(0) in _RANK and out:
            out.append(ahead.pop(0))
        elif word(0) in FILLERS:
            ahead.pop(0)
        else:
            break
    return " ".join(out) or None


def _automaton(phrases) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in phrases:
        a.add_word(x, x)
    a.make_automaton()
    return a


class Scanner:
    """Scans one text at a time; made once for each task."""

    def __init__(self):
        self.phrases = _automaton(f" {x} " for x in [*BASE_PHRASES, *MORE_PHRASES, *PROSE])
        self.tags = _automaton(TAGS)

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(_WORDS).split()
        line = f" {b' '.join(words).decode('utf-8', 'replace')} "
        base, labels, starts, score = set(), set(), [], 0.0
        at: list[int] = []
        expressions, verdicts = [], []
        for end, phrase in self.phrases.iter(line):
            key = phrase[1:-1]
            if key in PROSE:
                after = prose_expression(line, end + 1)
                if after and (found := parse_expression(after)):
                    expressions.append(found[0])
                    verdicts.append(found[1]["permissive"])
                    labels |= found[1]["labels"]
                    score = 1.0
            elif key in BASE_PHRASES:
                base.add(BASE_PHRASES[key])
                # where each word starts in the line, found once: places are then looked up
                at = at or list(accumulate((len(w) + 1 for w in line.split(" ")[1:]), initial=1))
                starts.append(bisect_left(at, end - len(phrase) + 2))
                score = max(score, 0.9)
            else:
                labels.add(MORE_PHRASES[key])
                score = max(score, 0.8)
        lowered = raw.lower()
        if b"license-" in lowered:
            text = lowered.decode("utf-8", "replace")
            for end, _ in self.tags.iter(text):
                if found := parse_expression(text, end + 1):
                    expressions.append(found[0])
                    verdicts.append(found[1]["permissive"])
                    labels |= found[1]["labels"]
                    score = 1.0
        permissive = None if not verdicts or None in verdicts else all(verdicts)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), score, "; ".join(expressions) or None, permissive,
        )


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in batches:
        rows = [scanner.scan(x) for x in texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every whole text: see the module for what each case gives."""
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), _scan_batches, SCHEMA)
