"""Secret scans through a trigram index, with built-in functions only.

Each rule's regular expression yields a Boolean query over trigrams that every
match must contain. The trigrams of all rules are the dictionary of an inverted
index that is sharded by document: each row holds the dictionary trigrams that
occur in its text, which is what the posting lists say about that document, so
intersecting them needs no shuffle and no text moves. Rules whose query holds
are verified with their regular expression; rules without mandatory trigrams
scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name
from .spans import SPAN, match_spans

_MAX_STRINGS, _MAX_CLASS, _MAX_ALTERNATIVES = 64, 4, 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: (group, least length) that a match must have, if any
    keep: tuple[int, int] | None = None
    base: bool = False


#: The first three are the base rules, in the order that breaks ties. The
#: classes are maximal runs, so a least length in the pattern drops exactly the
#: matches that are too short.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 8), True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", None, True),
    Rule("hex", r"[0-9a-f]{32,}", None, True),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("session_access", r"ASIA[A-Z0-9]{12,}"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("code_host_pat", r"github_pat_[A-Za-z0-9_]{30,}"),
    Rule("lab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("chat_webhook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("oauth_token", r"ya29\.[0-9A-Za-z_-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}"),
    Rule("index_token", r"pypi-AgE[A-Za-z0-9_-]{50,}"),
    Rule("cloud_token", r"do[opr]_v1_[a-f0-9]{64}"),
    Rule("storage_key", r"AccountKey=[A-Za-z0-9+/=]{40,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-zA-Z][a-zA-Z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
    Rule("bot_token", r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}\b"),
)


def _fold(s: str) -> str:
    return s.lower() if s.isascii() else s


def strings_of(item) -> set[str] | None:
    """All strings that a piece of the parsed expression matches, if they are few."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {_fold(chr(arg))}
    if op == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(_fold(chr(x)))
            elif str(kind) == "RANGE" and x[1] - x[0] < _MAX_CLASS:
                out |= {_fold(chr(c)) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= _MAX_CLASS + 4 else None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op == "AT":
        return {""}
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 2 or op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] <= 8:
        one = _sequence(arg[2])
        if one is None:
            return None
        out = set()
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(p) for p in product(sorted(one), repeat=n)}
        return out if len(out) <= _MAX_STRINGS else None
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = strings_of(item)
        if more is None or len(out) * len(more) > _MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _cuts(strings: set[str]) -> list[frozenset[str]]:
    """OR over the strings of the AND of their trigrams; empty: nothing is mandatory."""
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [] if frozenset() in out else sorted(out, key=sorted)


#: Letters from common to rare in running text; other characters are rarer still.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Trigrams of an alternative that the index holds.
_TERMS = 3


def _rarity(trigram: str) -> int:
    return sum(_COMMON.index(c) if c in _COMMON else len(_COMMON) for c in trigram)


def _absorbed(alternatives: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without alternatives that imply another one."""
    return {a for a in alternatives if not any(b < a for b in alternatives)}


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that all occur in any match.

    An empty list means that no trigram is mandatory. Trigrams that an ignored
    case or an open class makes uncertain are left out, so the query holds for
    every text that has a match.
    """
    parse = re._parser.parse  # type: ignore[attr-defined]
    clauses: list[list[frozenset[str]]] = []

    def walk(items) -> None:
        run = {""}

        def flush() -> None:
            nonlocal run
            if cut := _cuts(run):
                clauses.append(cut)
            run = {""}

        for item in items:
            more = strings_of(item)
            if more is not None and len(run) * len(more) <= _MAX_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            flush()
            op, arg = str(item[0]), item[1]
            if more is not None:
                run = more
            elif op == "SUBPATTERN":
                walk(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
        flush()

    walk(parse(pattern))
    best: list[frozenset[str]] = [frozenset()]
    for clause in clauses:
        if len(best) * len(clause) <= _MAX_ALTERNATIVES:
            best = [a | b for a in best for b in clause]
    if best == [frozenset()]:
        return []
    # fewer trigrams make a weaker query that still holds; the rarest decide
    kept = {frozenset(sorted(a, key=lambda t: (-_rarity(t), t))[:_TERMS]) for a in _absorbed(set(best))}
    return sorted(_absorbed(kept), key=sorted)


@cache
def _plan(rules: tuple[Rule, ...]) -> tuple[tuple[str, ...], tuple[tuple[Rule, tuple[frozenset[str], ...]], ...]]:
    queries = tuple((r, tuple(trigram_query(r.pattern))) for r in rules)
    return tuple(sorted({t for _, q in queries for a in q for t in a})), queries


def _trie(trigrams: tuple[str, ...]) -> str:
    """One expression that captures the dictionary trigram at a position, overlaps included."""
    first: dict[str, list[str]] = {}
    for t in trigrams:
        first.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + "))"


def trigram_postings(text: Column, trigrams: tuple[str, ...]) -> Column:
    """The dictionary trigrams that occur in the lower-cased text: the index's entry of a document.

    One pass over the text finds them all.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_trie(trigrams)), F.lit(1)))


def holds(postings: Column, query: tuple[frozenset[str], ...]) -> Column:
    """The Boolean query: in some alternative, all trigrams have the document in their lists."""
    out = F.lit(False)
    for alternative in query:
        every = F.lit(True)
        for t in sorted(alternative):
            every = every & F.array_contains(postings, t)
        out = out | every
    return out


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rule"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``out``: array of (kind, start, end), by start, then rule order.

    Positions are code points, the end is exclusive. Null and empty texts give
    an empty array. Of overlapping matches of different kinds all stay. All
    columns of the input stay as they are, but for one named like ``out`` in
    whatever case, which is replaced.
    """
    trigrams, queries = _plan(rules)
    body = F.coalesce(F.col(text), F.lit(""))
    low, post = fresh_name(docs, "_secret_lower"), fresh_name(docs, "_secret_postings")
    indexed = docs.withColumn(low, F.lower(body)).withColumn(post, trigram_postings(F.col(low), trigrams)).drop(low)
    none = F.array().cast(SPAN)
    found = []
    for order, (rule, query) in enumerate(queries):
        may = holds(F.col(post), query) if query else F.lit(True)
        spans = F.when(may & body.rlike(rule.pattern), match_spans(body, rule.pattern, rule.keep)).otherwise(none)
        found.append(_named(spans, order, rule.kind))
    every = F.array_sort(F.concat(*found))
    return indexed.withColumn(out, every).drop(post)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace every secret by ``[kind]``; overlapping spans become one, named by the first.

    Null texts stay null. The columns of the input stay, with only the text changed.
    """
    spans = fresh_name(docs, "_secret_spans")
    found = find_secrets(docs, text, spans, rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(spans), start, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).drop(spans).select(*docs.columns)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    base = [r.kind for r in rules if r.base]
    rows = find_secrets(docs.select("doc_id", "text"), "text", "secrets", rules)
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("secrets", lambda s: s["kind"].isin(base))
    return rows.select(
        "doc_id",
        *[_count("secrets", k).alias(f"n_{k}") for k in base],
        F.sha2(said(of_base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )
