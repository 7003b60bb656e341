"""Secret scans through a trigram index: each rule's pattern gives a Boolean query over trigrams, the postings of an index sharded
by document are intersected, and only the texts left are searched with the pattern itself. Rules whose pattern demands no
trigram search every text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from re import _constants as C
from re import _parser as P
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import flat, slices


class Rule(NamedTuple):
    """Matches are leftmost and do not overlap; one whose `group` has fewer than `least` characters is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a maximal run of 32 or more: the matches of [0-9a-f]+ that are long enough
)
# Published shapes of other credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: Strings that a stretch of a pattern may stand for; a stretch with more is cut there, which only loosens the query.
MOST_STRINGS = 64
#: Characters of a class up to which it counts as its characters one by one.
SMALL_CLASS = 8
Query = list[list[frozenset[int]]]  # all of: any of: all trigrams


def _low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _trigrams(text: str) -> frozenset[int]:
    b = text.encode()
    return frozenset(b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2))


def _clause(strings: Iterable[str]) -> list[list[frozenset[int]]]:
    """What a text must hold that holds one of the strings: nothing, if a string is too short to tell."""
    sets = {_trigrams(s) for s in strings}
    if not all(sets):
        return []
    return [sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)]


def _stretches(nodes: Iterable) -> tuple[set[str], Query, set[str]] | set[str]:
    """The finite set of strings that the nodes stand for; or (strings a match begins with, query, strings it ends with)."""
    front: set[str] | None = None  # beginnings, once something without end has been met
    now, query = {""}, []

    def broken(begin: set[str], inner: Query, end: set[str]) -> None:
        nonlocal front, now, query
        joined = {a + b for a in now for b in begin}
        query = query + inner
        if front is None:
            front = joined
        else:
            query = query + _clause(joined)
        now = end

    for node in nodes:
        part = _part(*node)
        if isinstance(part, set) and len(part) * len(now) <= MOST_STRINGS:
            now = {a + b for a in now for b in part}
        elif isinstance(part, set):
            broken({""}, _clause(part), {""})
        else:
            broken(*part)
    return now if front is None else (front, query, now)


def _part(op, value) -> tuple[set[str], Query, set[str]] | set[str]:
    anything = ({""}, [], {""})
    if op is C.LITERAL:
        return {_low(chr(value))}
    if op is C.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is C.LITERAL:
                chars.add(_low(chr(v)))
            elif kind is C.RANGE and v[1] - v[0] < MOST_STRINGS:
                chars |= {_low(chr(c)) for c in range(v[0], v[1] + 1)}
            else:
                return anything
        return chars if len(chars) <= SMALL_CLASS else anything
    if op is C.SUBPATTERN:
        return _stretches(value[3])
    if op is C.BRANCH:
        parts = [_stretches(p) for p in value[1]]
        if all(isinstance(p, set) for p in parts):
            return set().union(*parts)
        queries = [_whole(p) for p in parts]
        if all(len(q) == 1 for q in queries):  # one clause each: their union is a clause
            return {""}, [[s for q in queries for s in q[0]]], {""}
        return anything
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _stretches(inner)
        if isinstance(part, set) and most == 1:
            return part | ({""} if least == 0 else set())
        if least == 0:
            return anything
        if isinstance(part, set):
            return (part, [], part)
        return part if least == most == 1 else (part[0], part[1], part[2])
    if op is C.AT:
        return {""}
    return anything


def _whole(part) -> Query:
    return _clause(part) if isinstance(part, set) else _clause(part[0]) + part[1] + _clause(part[2])


def trigram_query(pattern: str) -> Query:
    """Trigrams of A-Z-lowered UTF-8 that every text with a match holds: all clauses, of each one alternative, of it all trigrams.
    An empty query demands nothing."""
    return _whole(_stretches(P.parse(pattern, re.ASCII)))


class Postings:
    """The index of one shard: for each trigram of the vocabulary the texts that hold it, as a row of flags."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray):
        data, borders = flat(texts)
        self.rows = len(borders) - 1
        self.vocabulary = vocabulary
        self.held = np.zeros((len(vocabulary), self.rows), bool)
        if len(data) < 3 or not len(vocabulary):
            return
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        low = fold[data].astype(np.uint32)
        pairs = np.zeros(1 << 16, bool)
        pairs[vocabulary >> 8] = True
        heads = low[:-1] << 8
        heads |= low[1:]
        at = np.flatnonzero(pairs[heads[:-1]])
        code = heads[at] << 8 | low[at + 2]
        place = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
        row = np.searchsorted(borders, at, "right") - 1
        known = (vocabulary[place] == code) & (at + 2 < borders[row + 1])
        self.held[place[known], row[known]] = True

    def of(self, trigrams: frozenset[int]) -> np.ndarray:
        return self.held[np.searchsorted(self.vocabulary, sorted(trigrams))].all(axis=0)

    def answer(self, query: Query) -> np.ndarray:
        """Texts that may match: postings intersected within an alternative, united over them, intersected over clauses."""
        out = np.ones(self.rows, bool)
        for clause in query:
            out &= np.any([self.of(t) for t in clause], axis=0)
        return out


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@functools.cache
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = np.array(sorted({t for q in queries for clause in q for s in clause for t in s}), np.uint32)
    return queries, vocabulary, [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vocabulary, patterns = _prepared(rules)
        for b in slices(batches, "text", 1 << 20):
            index = Postings(b.column("text"), vocabulary)
            may = np.array([index.answer(q) for q in queries]).reshape(len(rules), b.num_rows)
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row in np.flatnonzero(may.any(axis=0)).tolist():
                text = b.column("text")[row].as_py()
                if not text:
                    continue
                spans = []
                for k in np.flatnonzero(may[:, row]).tolist():
                    group, least = rules[k].group, rules[k].least
                    spans += [(m.start(), k, m.end()) for m in patterns[k].finditer(text) if m.end(group) - m.start(group) >= least]
                found[row] = [{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(spans)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return run


def find(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, spans (kind, start, end in code points, end exclusive), by start and then in
    the order of the rules.

    Letter case counts unless the rule says any_case, which holds for A-Z only. Matches of different rules may overlap. Every
    whole text is indexed, however long. Null or empty text: no spans. Rows that share a doc_id, or have none, are
    searched one by one. No rows: no rows. Other columns are ignored."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan(tuple(rules)), f"doc_id long, spans {SPANS}")


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Iterable[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs' doc_id and text with every maximal stretch that spans cover replaced by `mark`, and n_found. Edge cases as in `find`; a
    null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            (told,) = _scan(tuple(rules))(iter([b]))
            texts = b.column("text").to_pylist()
            counts = []
            for i, spans in enumerate(told.column("spans").to_pylist()):
                counts.append(len(spans))
                out, done = [], 0
                for s in spans:
                    if s["start"] >= done and (s["start"] > done or not out):
                        out += [texts[i][done : s["start"]], mark]
                    done = max(done, s["end"])
                if out:
                    texts[i] = "".join([*out, texts[i][done:]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_found"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text string, n_found long")


def digests(found: DataFrame, base: Iterable[Rule] = BASE) -> DataFrame:
    """What `find` gave, as counts per base kind, the sha256 of the base spans and all spans as one string."""
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(shown(own).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
