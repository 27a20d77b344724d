"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression is parsed on the driver into a Boolean trigram query: a list of
   clauses, each a set of trigrams (folded to lower case) that every match must contain. A rule with
   a clause that mandates no trigram, such as a run of hex digits, has no query and is scanned fully.
2. ``trigram_index`` lists, for the trigrams that the rules mention, the postings (trigram, key).
3. ``candidates`` intersects postings: a key is a rule's candidate if it is in every list of a clause.
4. ``scan_secrets`` verifies candidates with the regular expression itself.

The key hashes a row's id and whole text, so null or repeated ids are no concern; a collision of
keys only adds a candidate, which verification then settles. Keys are spread evenly however large a
source or a group of copies is.

Cases: null text is the empty text; a text without secrets has the empty span list; repeated rows
each give their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost, without overlap; a match whose ``group`` has fewer than ``least``
    characters is dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The three base kinds, in their order.
BASE_RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Public credential formats beside the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
GAP = None
MOST_CLAUSES = 64


def _letter(items) -> str | None:
    """The one folded character of a class such as [Pp], else None."""
    seen = {chr(v).lower() for op, v in items if op is sre.LITERAL}
    return seen.pop() if len(seen) == 1 and all(op is sre.LITERAL for op, _ in items) else None


def _expand(parsed) -> list[tuple]:
    """Every way through a parsed pattern, as literal runs and gaps."""
    ways: list[tuple] = [()]
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts = [(chr(arg).lower(),)]
        elif op is sre.IN:
            parts = [(_letter(arg),)]
        elif op is sre.BRANCH:
            parts = [w for one in arg[1] for w in _expand(one)]
        elif op is sre.SUBPATTERN:
            parts = _expand(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inside = _expand(body)
            if (low, int(high)) == (0, 1):
                parts = [(), *inside]
            elif low:
                parts = [(*w, GAP) for w in inside]
            else:
                parts = [(GAP,)]
        else:
            parts = [(GAP,)]
        ways = [(*a, *b) for a in ways for b in parts]
        if len(ways) > MOST_CLAUSES:
            return [(GAP,)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of which one must hold in full for a match; None if the pattern mandates no trigram."""
    clauses: set[frozenset[str]] = set()
    for way in _expand(_parser.parse(pattern)):
        runs = "".join("\0" if c is GAP else c for c in way).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _queries(rules) -> dict[str, list[frozenset[str]]]:
    return {r.kind: q for r in rules if (q := trigram_query(r.pattern))}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key of every row."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def trigram_index(rows: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries mention."""
    vocabulary = sorted({g for q in _queries(rules).values() for c in q for g in c})
    folded = rows.select("key", F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in vocabulary]))
    return folded.select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the rules whose query the key's postings satisfy. Keys without a kind are left out.

    The lists are intersected as one bit per trigram and key, so the map side already has a row a key.
    """
    queries = _queries(rules)
    place = {g: i for i, g in enumerate(sorted({g for q in queries.values() for c in q for g in c}))}
    words = range(len(place) // 62 + 1)
    where = F.create_map(*[F.lit(x) for g, i in place.items() for x in (g, i)])
    bits = index.select("key", where[F.col("trigram")].alias("i"))
    masks = bits.groupBy("key").agg(
        *[F.bit_or(F.when(F.expr(f"i div 62 = {w}"), F.expr("shiftleft(1L, i % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    )

    def holds(clause):
        need = [sum(1 << place[g] % 62 for g in clause if place[g] // 62 == w) for w in words]
        test = F.lit(True)
        for w, bits in enumerate(need):
            if bits:
                test = test & (F.col(f"w{w}").bitwiseAND(F.lit(bits)) == F.lit(bits))
        return test

    def any_of(clauses):
        test = F.lit(False)
        for c in clauses:
            test = test | holds(c)
        return test

    kinds = F.array_compact(F.array(*[F.when(any_of(q), F.lit(k)) for k, q in queries.items()]))
    return masks.select(F.col("key"), kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, order: int):
    """Spans of a rule's matches that pass, in code points: what lies between matches and the matches' lengths give the places."""
    lengths = (
        f"transform(arrays_zip(p{order}, m{order}, g{order}), x -> "
        f"named_struct('before', length(x.p{order}), 'long', length(x.m{order}), 'group', length(x.g{order})))"
    )
    state = "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,rank:int,stop:int>>))"
    step = (
        f"(s, x) -> named_struct('at', s.at + x.before + coalesce(x.long, 0), 'out', if(x.group >= {rule.least}, "
        f"concat(s.out, array(named_struct('start', s.at + x.before, 'rank', {order}, 'stop', s.at + x.before + x.long))), s.out))"
    )
    return F.expr(f"if(size(m{order}) = 0, {state}.out, aggregate({lengths}, {state}, {step}, s -> s.out))")


def shortest(rule: Rule) -> str:
    """A pattern that every text with a passing match contains; of a run of one class, the run's least length."""
    if rule.group == 0 and _parser.parse(rule.pattern).getwidth()[0] == 1 and rule.pattern.endswith("]+"):
        return rule.pattern.removesuffix("+") + "{%d}" % rule.least
    return rule.pattern


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text, spans array<struct<start, rank, stop>>: rank is the rule's place in ``rules``; sorted by start, then rank."""
    rows = keyed(docs)
    found = candidates(trigram_index(rows, rules), rules)
    queries = _queries(rules)
    both = rows.join(found.withColumnRenamed("key", "found_key"), F.col("key") == F.col("found_key"), "left")
    columns, empty = [], F.expr("cast(array() as array<string>)")
    for i, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        maybe = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in queries else F.col("text").rlike(shortest(r))
        columns += [
            F.when(maybe, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(empty).alias(f"m{i}"),
            F.when(maybe, F.regexp_extract_all("text", pattern, F.lit(r.group))).otherwise(empty).alias(f"g{i}"),
            F.when(maybe, F.split("text", r.pattern, -1)).otherwise(empty).alias(f"p{i}"),
        ]
    matched = both.select("doc_id", "text", *columns)
    return matched.select("doc_id", "text", F.array_sort(F.concat(*[_spans(r, i) for i, r in enumerate(rules)])).alias("spans"))


def span_names(spans, rules=RULES):
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, rules=RULES, mask: str = "[REDACTED]") -> DataFrame:
    """All columns of docs, with every span of ``text`` replaced by the mask (overlapping spans by one) and
    ``n_chars``, where there is such a column, counted anew. Null text stays null."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("doc_id"), F.col("text"))  # the whole row travels as the id
    scanned = scan_secrets(packed, rules)
    # walk the spans once: 'at' is the end of what is already written
    cut = F.expr(
        "aggregate(spans, named_struct('at', 0, 'out', ''), (s, x) -> if(x.start < s.at, "
        "named_struct('at', greatest(s.at, x.stop), 'out', s.out), "
        f"named_struct('at', x.stop, 'out', concat(s.out, substring(text, s.at + 1, x.start - s.at), '{mask}'))), "
        "s -> concat(s.out, substring(text, s.at + 1, length(text))))"
    )
    fresh = scanned.select("doc_id", F.when(F.col("doc_id.text").isNull(), F.lit(None).cast("string")).when(F.size("spans") > 0, cut).otherwise(F.col("text")).alias("clean"), F.size("spans").alias("found"))
    out = []
    for c in names:
        if c == "text":
            out.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            out.append(F.when(F.col("found") > 0, F.length("clean").cast(kind)).otherwise(F.col("doc_id.n_chars")).alias("n_chars"))
        else:
            out.append(F.col("doc_id")[c].alias(c))
    return fresh.select(*out)
