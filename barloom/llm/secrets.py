"""Secret scans through a trigram inverted index.

Each rule's pattern is turned into a Boolean query of trigrams that any match must have. Postings (trigram, text) are made
for the trigrams of the queries; intersecting them gives the texts that a rule can match, and only those are run against
its pattern. A rule without mandatory trigrams is run against every text. Column functions only.

Defined results: null text counts as empty; texts of any length are read whole; matches are leftmost and do not overlap
within a kind; places are code points, end exclusive; spans that start together are in the order of the rules; an empty
table gives no rows; repeated rows stay, and equal texts have equal spans; other columns are kept, whatever their names.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

try:  # the parser of patterns has moved between versions of Python
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import session_of, stored, text_or_empty

#: Texts that a rule can match, for the whole table, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, in either ASCII case if any_case, whose group has `least` characters at least."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: The base kinds in their fixed order. Runs of one class are maximal, so a bound on the match can stand in the pattern.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds of credential with public, fixed formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def _strings(node, most: int = 32) -> list[str] | None:
    """All strings that one parsed node can match, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return [chr(value)]
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= 8:
        return [chr(v) for _, v in value]
    if kind is sre.SUBPATTERN:
        return _sequence(value[3], most)
    if kind is sre.BRANCH:
        found = [_sequence(x, most) for x in value[1]]
        return None if any(x is None for x in found) else list(itertools.chain(*found))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 4:
        once = _sequence(value[2], most)
        if once is not None:
            out = ["".join(p) for n in range(value[0], value[1] + 1) for p in itertools.product(once, repeat=n)]
            return out if len(out) <= most else None
    return None


def _sequence(nodes, most: int) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _strings(node, most)
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match has; None if there is none."""
    query: list[frozenset[str]] | None = None
    run = [""]

    def close() -> None:
        nonlocal query, run
        terms = {trigrams(s.lower()) for s in run}
        if all(terms):
            terms = {t for t in terms if not any(o < t for o in terms)}
            query = sorted(terms if query is None else {a | b for a in query for b in terms}, key=sorted)
        run = [""]

    for node in sre_parse.parse(pattern):
        kind, value = node
        more = _strings(node)
        if more is None and kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] and len(value[2]) == 1:
            more = None
        if more is None or len(run) * len(more) > 32:
            close()
            if more is not None:
                run = more
        else:
            run = [a + b for a in run for b in more]
    close()
    return query


def postings(docs: DataFrame, queries: dict[int, list[frozenset[str]]], text: Column) -> tuple[DataFrame, dict[str, int]]:
    """The index: (trigram, t) for each text hash t and each trigram of the queries that the text has."""
    number = {g: i for i, g in enumerate(sorted(set().union(*(term for q in queries.values() for term in q))))}
    low = docs.select(F.xxhash64(text).alias("t"), F.lower(text).alias("low"))
    grams = F.lit(list(number))
    has = F.filter(F.lit(list(range(len(number)))), lambda i: F.contains("low", F.get(grams, i)))
    return low.select("t", F.explode(has).alias("trigram")), number


def candidates(index: DataFrame, number: dict[str, int], queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(t, rules): the rules, as bits, whose query the postings of text t fulfil."""
    words = -(-len(number) // 62)
    bits = lambda grams: [sum(1 << number[g] % 62 for g in grams if number[g] // 62 == w) for w in range(words)]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 62)
    held = index.groupBy("t").agg(*(F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)))

    def fulfils(term: frozenset[str]) -> Column:
        out = F.lit(True)
        for w, need in enumerate(bits(term)):
            if need:
                out &= F.col(f"w{w}").bitwiseAND(F.lit(need)) == need
        return out

    rules = F.lit(0)
    for i, query in queries.items():
        ok = F.lit(False)
        for term in query:
            ok |= fulfils(term)
        rules = rules.bitwiseOR(F.when(ok, F.lit(1 << i)).otherwise(0))
    return held.select("t", rules.alias("rules")).filter("rules != 0")


def matches_of(rule: Rule, text: Column, wanted: Column | None) -> tuple[Column, Column]:
    """The rule's matches in a text, and what lies between them; null where there are none."""
    able = text.rlike(rule.java) if wanted is None else wanted & text.rlike(rule.java)
    return F.when(able, F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))), F.when(able, F.split(text, F.lit(rule.java), F.lit(-1)))


def spans_of(rule: Rule, order: int, found: str, between: str) -> Column:
    """The rule's spans (start, kind_no, end, kind), from columns of matches_of(): lengths give the places."""
    spans = "array<struct<start: int, kind_no: int, end: int, kind: string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        start = acc["at"] + F.length(F.get(between, i))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), (start + F.length(m)).alias("end"), F.lit(rule.kind).alias("kind"))
        ok = F.length(F.regexp_extract(m, rule.java, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct((start + F.length(m)).alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    places = F.sequence(F.lit(0), F.size(found) - 1)
    return F.when(F.col(found).isNotNull(), F.aggregate(places, zero, step, lambda a: a["out"])).otherwise(zero["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """docs with `spans`, in place of a column of that name: all rules' spans in order of start, then of rules."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    extra = {c: f"x{i}" for i, c in enumerate(docs.columns) if c != "spans"}  # names that clash with none here
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in extra.items()), text_or_empty(text_column).alias("text"))
    able = plain.withColumn("t", F.xxhash64("text"))
    if queries:
        index, number = postings(plain, queries, F.col("text"))
        found = stored(candidates(stored(index, "secret-postings"), number, queries), "secret-candidates").withColumnRenamed("t", "of")
        few = found.count() <= BROADCAST_ROWS
        able = able.join(F.broadcast(found) if few else found, F.col("t") == F.col("of"), "left")
    else:
        able = able.withColumn("rules", F.lit(None).cast("int"))
    found = {i: matches_of(r, F.col("text"), F.coalesce(F.col("rules").bitwiseAND(1 << i) != 0, F.lit(False)) if i in queries else None) for i, r in enumerate(rules)}
    matched = able.withColumns({f"{kind}{i}": c for i, both in found.items() for kind, c in zip("mb", both)})
    spanned = matched.withColumn("spans", F.sort_array(F.concat(*(spans_of(r, i, f"m{i}", f"b{i}") for i, r in enumerate(rules)))))
    return spanned.select(*(F.col(x).alias(c) for c, x in extra.items()), "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    return scan(docs.select("doc_id", "text")).select("doc_id", *(count(k) for k in range(len(BASE))), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """docs with every span of the text replaced by mark; overlapping spans get one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    name = plain[docs.columns.index(text_column)]
    text = F.col(name)

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, more).otherwise(acc["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    scanned = scan(docs.toDF(*plain), RULES, name)
    marked = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)).otherwise(text).alias(name)
    return scanned.select(*(marked if c == name else c for c in plain)).toDF(*docs.columns)
