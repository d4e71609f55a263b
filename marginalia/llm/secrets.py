"""Operator 10, secret scans: trigram queries derived from the rules, an inverted index over blocks of documents, and verification.

From each rule's syntax tree a Boolean query of trigrams is derived (AND of ORs) that every match satisfies. A block of documents is indexed
by those trigrams, over A-Z lower-cased bytes; intersecting postings leaves the candidates, and only they are searched with
the rule. A rule that implies no trigram scans every document.

Defined results: null or empty text: no spans, the digest of an empty string; null doc_id passes through; repeated rows get a row each; an
empty table gives no rows; other columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from . import common
from .shingles import slices

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0  # characters that the group must have
    base: bool = False


#: Base rules first, in the order of the contract; the others follow.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

MOST_STRINGS = 64


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _trigrams(text: str) -> frozenset[bytes]:
    raw = _lower(text).encode()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


class _Query:
    """What a piece of a pattern implies: ``exact``, all the strings it can match, if they are few, else the clauses found."""

    def __init__(self, exact: set[str] | None, clauses: set[frozenset[frozenset[bytes]]]):
        self.exact, self.clauses = exact, clauses

    def all_clauses(self) -> set[frozenset[frozenset[bytes]]]:
        """Each clause is an OR of ANDs of trigrams."""
        if self.exact is None:
            return self.clauses
        options = frozenset(_trigrams(x) for x in self.exact)
        return self.clauses | ({options} if options and all(options) else set())


def _sequence(parts: list[_Query]) -> _Query:
    """Runs of exact pieces are multiplied out; a piece without a list of strings ends a run and adds its clauses."""
    clauses: set = set()
    run: set[str] | None = {""}
    whole = True
    for part in parts:
        if part.exact is not None and len(run) * len(part.exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in part.exact}
            clauses |= part.clauses
        else:
            clauses |= _Query(run, set()).all_clauses() | (part.clauses if part.exact is None else set())
            whole = whole and False
            run = part.exact if part.exact is not None else {""}
    if whole:
        return _Query(run, clauses)
    return _Query(None, clauses | _Query(run, set()).all_clauses())


def _derive(tree) -> _Query:
    parts = []
    for op, value in tree:
        if op is sre.LITERAL:
            parts.append(_Query({chr(value)}, set()))
        elif op is sre.SUBPATTERN:
            parts.append(_derive(value[3]))
        elif op is sre.BRANCH:
            options = [_derive(x) for x in value[1]]
            if all(o.exact is not None for o in options):
                parts.append(_Query(set().union(*(o.exact for o in options)), set()))
            else:  # one clause: for each option the strongest AND it implies
                each = []
                for o in options:
                    found = [next(iter(c)) for c in o.all_clauses() if len(c) == 1]
                    wide = [c for c in o.all_clauses() if len(c) > 1]
                    each.append({frozenset().union(*found)} if found else set(wide[0]) if wide else None)
                parts.append(_Query(None, {frozenset().union(*each)} if all(each) else set()))
        elif op is sre.IN and not any(k in (sre.NEGATE, sre.CATEGORY) for k, _ in value):
            size = sum(1 if k is sre.LITERAL else v[1] - v[0] + 1 for k, v in value)
            chars = {chr(c) for k, v in value for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))} if size <= 16 else None
            parts.append(_Query(chars, set()))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            one = _derive(inner)
            if (low, high) == (0, 1) and one.exact is not None:
                parts.append(_Query(one.exact | {""}, set()))
            elif low >= 1:
                parts.append(_Query(None, one.all_clauses()))
            else:
                parts.append(_Query(None, set()))
        elif op is sre.AT:
            continue
        else:
            parts.append(_Query(None, set()))
    return _sequence(parts)


def trigram_query(pattern: str, flags: int = 0) -> list[list[frozenset[bytes]]]:
    """AND over clauses, each an OR over sets of trigrams that must all occur; empty when the pattern implies none."""
    clauses = _derive(sre_parse.parse(pattern, flags & ~re.A)).all_clauses()
    return sorted((sorted(c, key=sorted) for c in clauses), key=lambda c: (len(c), sorted(map(sorted, c))))


class Index:
    """Postings of the wanted trigrams over one block of documents."""

    def __init__(self, wanted: list[bytes], texts: list[bytes]):
        self.n, self.number = len(texts), {t: i for i, t in enumerate(wanted)}
        slot = _slots(tuple(wanted))
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)].astype(np.uint32)
        found = np.zeros((len(wanted), self.n), bool)
        if len(data) >= 3:
            code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            hit = slot[code]
            at = np.flatnonzero(hit)
            ends = np.cumsum([len(t) + 1 for t in texts])
            start, doc = at, np.searchsorted(ends, at, side="right")
            inside = start + 2 < ends[np.minimum(doc, self.n - 1)]
            found[hit[at[inside]] - 1, doc[inside]] = True
        self.postings = [np.flatnonzero(row) for row in found]

    def candidates(self, query: list[list[frozenset[bytes]]]) -> np.ndarray:
        out = np.arange(self.n)
        for clause in query:
            union = np.zeros(0, np.int64)
            for option in clause:
                own = out
                for t in option:
                    own = np.intersect1d(own, self.postings[self.number[t]], assume_unique=True)
                union = np.union1d(union, own)
            out = union
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_slot_tables: dict[tuple, np.ndarray] = {}


def _slots(wanted: tuple[bytes, ...]) -> np.ndarray:
    if wanted not in _slot_tables:
        table = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for i, t in enumerate(wanted):
            table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        _slot_tables[wanted] = table
    return _slot_tables[wanted]


def spans_of(rule: Rule, matcher: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in matcher.finditer(text) if len(m[rule.group]) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``: array of ``(kind, start, end)`` by start, then in the order of the rules."""

    def run(batches):
        # letters in either case means A-Z, so patterns match by ASCII rules
        matchers = [re.compile(r.pattern, r.flags | re.A) for r in rules]
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        wanted = sorted({t for q in queries for c in q for o in c for t in o})
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
            for a, b in slices(sizes):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                index = Index(wanted, [t.encode() for t in texts])
                found: list[list] = [[] for _ in texts]
                for k, (rule, matcher, query) in enumerate(zip(rules, matchers, queries, strict=True)):
                    for i in index.candidates(query).tolist():
                        found[i] += [(start, k, end) for start, end in spans_of(rule, matcher, texts[i])]
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(common.table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> dict:
    """The base result of one document without index, for tests."""
    text, spans = text or "", []
    for k, rule in enumerate(r for r in RULES if r.base):
        spans += [(s, k, rule.kind, e) for s, e in spans_of(rule, re.compile(rule.pattern, rule.flags | re.A), text)]
    joined = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))
    return {**{f"n_{k}": sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")}, "base_sha256": hashlib.sha256(joined.encode()).hexdigest()}
