"""Secret scan: all rules in one automaton, one pass over the bytes of a text; spans by automata as well."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.automaton import Automaton, compile_patterns
from epispark.llm.words import slices, text_bytes


@dataclass(frozen=True)
class Rule:
    """``pattern`` with a part (``group``) of at least ``least`` characters.

    ``whole`` matches what counts, for the rule's own automata: the pattern with that least
    length in it. ``form`` is the same for the automaton of all rules, where least lengths may be
    left out: together they need a state for each combination of lengths. With ``consumes`` a
    match that is too short takes its place all the same. A pattern that is no regular one has
    its regular beginning as ``whole``, and ``goes_on`` is set.
    """

    kind: str
    pattern: str
    whole: str
    form: str
    group: int = 0
    least: int = 1
    consumes: bool = False
    goes_on: bool = False


# The kinds of secrets and their forms, in the order they are listed.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
# A private key goes on to the END line of its BEGIN line, whatever stands between (quotes, escaped
# line ends); without one to the end of its base64 lines, with the headers before them.
_EOL = r"(?:\r?\n|\r|\\r\\n|\\n)"
_LINE = rf"""[\t >]*[A-Za-z0-9+/]+={{0,2}}(?=[\t ]*(?:{_EOL}|["',]|\Z))"""
_LINES = rf"{_LINE}(?:[\t ]*{_EOL}{_LINE})*+"
_HEADERS = rf"(?:[\t >]*[A-Za-z][A-Za-z0-9-]*:[^\r\n]*{_EOL})*(?:[\t >]*{_EOL})*"
_PRIVATE = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
    r"(?:(?:[^-]+|-(?!----(?:BEGIN|END) ))*+-----END \1PRIVATE KEY-----"
    rf"|[\t ]*{_EOL}{_HEADERS}{_LINES}"
    r"|(?:[\t ]+[A-Za-z0-9+/]{20,}={0,2})++)?"
)
_SIGNED = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
RULES = (
    Rule("assign", _ASSIGN.replace("(?i:", "(?ai:") + "+)", _ASSIGN + "{8,})", _ASSIGN + "{8,})", 2, 8, consumes=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32,}", r"[0-9a-f]{32,}", 0, 32),
    *(Rule(kind, pattern, pattern, form) for kind, pattern, form in (
        ("repo", r"gh[opsu]_[A-Za-z0-9]{36,}", r"gh[opsu]_[A-Za-z0-9]+"),
        ("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}", r"xox[abprs]-[A-Za-z0-9-]+"),
        ("live", r"[rs]k_live_[A-Za-z0-9]{16,}", r"[rs]k_live_[A-Za-z0-9]+"),
        ("signed", _SIGNED, _SIGNED.replace("{10,}", "+")),
    )),
    Rule("private", _PRIVATE, _BEGIN, _BEGIN, goes_on=True),
)
BASE = ("assign", "access", "hex")

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class _Bounds:
    """What finds the bounds of a rule's matches where it occurs: one automaton reads back over the
    text and tells where matches begin, one reads on from there to the end of the longest."""

    back: Automaton
    on: Automaton
    tail: re.Pattern | None

    def spans(self, raw: bytes, last: int) -> list[tuple[int, int]]:
        coded, at, found = raw.translate(self.on.classes), 0, []
        text = raw.decode("latin-1") if self.tail else ""
        for read in reversed(self.back.places(raw[:last][::-1])):
            start = last - read
            if start < at:
                continue
            at, told = self.on.longest(coded, start)
            if self.tail:
                at = self.tail.match(text, start).end()
            if 0 in told:
                found.append((start, at))
        return found


@lru_cache(maxsize=8)
def _scanner(rules: tuple[Rule, ...]) -> tuple[Automaton, list[_Bounds]]:
    bounds = []
    for rule in rules:
        whole = rule.whole.encode()
        forms = [whole, rule.pattern.encode()] if rule.consumes else [whole]
        bounds.append(_Bounds(
            compile_patterns(forms[-1:], turned=True), compile_patterns(forms, anchored=True),
            re.compile(rule.pattern) if rule.goes_on else None,
        ))
    return compile_patterns([r.form.encode() for r in rules]), bounds


def _spans(raw: bytes, automaton: Automaton, bounds: list[_Bounds], rules: tuple[Rule, ...]) -> list[tuple]:
    found = sorted(
        (a, k, b) for k, last in automaton.ends(raw).items() for a, b in bounds[k].spans(raw, last)
    )
    if not found:
        return []
    points = None if raw.isascii() else np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [
        (rules[k].kind, a, b) if points is None else (rules[k].kind, int(points[a]), int(points[b])) for a, k, b in found
    ]


def _each(part: pa.RecordBatch, text: str, scanner, rules) -> list[list[tuple]]:
    offsets, data = text_bytes(part.column(text))
    return [
        _spans(data[a:b].tobytes(), *scanner, rules) for a, b in zip(offsets.tolist(), offsets[1:].tolist())
    ]


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every secret, by start and rule.

    Start and end count code points, the end exclusive. All rules are compiled once, on the
    driver, into one minimal automaton; a task reads each byte of a text once and learns which
    rules have a match and where the last one ends. Only from there back the rule's own
    automaton, turned round, tells the beginnings of its matches, and from the leftmost one on
    the longest match is read: leftmost, not overlapping within a kind, too short ones dropped.
    The time is in proportion to the text. What a private key's BEGIN line is followed by is no
    regular language (the END line repeats its name), so a pattern of ``re`` reads on from there.

    One row per row of ``docs``, repeated ones included; a null or empty text has no spans.
    Other columns are not looked at.
    """
    scanner = _scanner(rules)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in _each(part, "text", scanner, rules)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"]
                )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", picked.schema["doc_id"].dataType), T.StructField("spans", SPANS)])
    return picked.mapInArrow(scan, schema).withColumnRenamed("doc_id", doc_id)


def redact_secrets(
    docs: DataFrame, text: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; touching spans become one.

    All other columns, the order of columns and null texts stay as they are.
    """
    scanner = _scanner(rules)

    def cover(raw: str, spans: list[tuple]) -> str:
        out, at = [], 0
        for _, a, b in spans:
            if a > at or not out:
                out += [raw[at:a], mark]
            at = max(at, b)
        return "".join(out) + raw[at:]

    def redact(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                texts = [
                    cover(t.as_py(), s) if s else t.as_py()
                    for t, s in zip(part.column(text), _each(part, text, scanner, rules))
                ]
                yield part.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(redact, docs.schema)
