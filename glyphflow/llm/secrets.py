"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's expression gives a Boolean trigram query.  The index holds a
posting (trigram, document) for each trigram that a rule can ask for; clause by
clause the postings are intersected with an aggregation, which shuffles ids
only.  A document meets a rule's expression only if it is a candidate of the
rule; rules without mandatory trigrams meet every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern``: an expression that Java, RE2 and Python read alike; ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self) -> list[frozenset[str]] | None:
        return trigram_query(self.pattern)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])
#: The contract's kinds. A run of hex digits matches whole or not at all, so its length can stand in the expression.
BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the index makes cheap to add; formats as their issuers document them.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
#: A key's banner with its headers and its body up to the END line, or to the body's end where that is missing.
_KEY = Rule("pem", ADDED[0].pattern + r"(?:\s*[A-Za-z-]+: [^\r\n]*[\r\n]+){0,8}(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)")
#: What redaction takes away; the report's spans of keys are their banners.
REDACTED = tuple(_KEY if r.kind == "pem" else r for r in RULES)
#: Column names in tables of this module's own: a row's number (see ``find_secrets``) and its text.
K, T = "row", "text"
#: Matches, and characters, that are worked through in one go: cost grows with their number times this.
RUN, CHUNK = 256, 1 << 16
SPANS = "array<struct<start:int,rule:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def postings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(K, gram): the inverted index's postings, for the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for clause in r.query or () for g in clause})
    if not grams:
        return rows.select(K, F.lit("").alias("gram")).limit(0)
    asked = F.array(*map(F.lit, grams))
    # The lower-case text is bound by the outer function; written out, it would be made anew for every trigram.
    held = _let(F.lower(T), lambda low: F.filter(asked, lambda g: F.contains(low, g)))
    return rows.select(K, F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(K, rules): the numbers of the rules with a clause all of whose trigrams have a posting for the document."""
    spark = index.sparkSession
    terms = [(g, number, part, 1 << bit, (1 << len(clause)) - 1) for number, rule in enumerate(rules) for part, clause in enumerate(rule.query or ()) for bit, g in enumerate(sorted(clause))]
    clauses = F.broadcast(spark.createDataFrame(terms, "gram string, rule int, part int, bit long, whole long"))  # as large as the rules are
    met = index.join(clauses, "gram").groupBy(K, "rule", "part").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"))
    return met.where("bits = whole").groupBy(K).agg(F.collect_set("rule").alias("rules"))


def _spans(text: str, rule: Rule, number: int) -> Column:
    """SPANS of a rule's matches: the lengths of matches and of what is between them give the places."""
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(part, F.length).alias("held"),
    )
    # Names come back by zipping the fields once more.
    sizes = F.transform(sizes, lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(x["size"], F.lit(0)).alias("size"), F.coalesce(x["held"], F.lit(-1)).alias("held")))
    empty = F.array().cast(SPANS)

    def step(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + x["gap"]
        end = begin + x["size"]
        mine = F.array(F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(so_far["out"], mine)).otherwise(so_far["out"]).alias("out"))

    def places(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda t, x: t + x["gap"] + x["size"]))

        def within(total: Column) -> Column:
            def run(r: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(total, F.lit(1), i), F.lit(0), lambda t, x: t + x)
                return F.aggregate(r, F.struct(before.alias("at"), empty.alias("out")), step, lambda x: x["out"])

            return F.flatten(F.transform(runs, run))

        return _let(totals, within)

    def cut(found: Column) -> Column:
        last = F.floor((F.size(found) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * RUN + 1, F.lit(RUN)))

    found = _let(sizes, lambda found: _let(cut(found), places))
    return F.when(F.col(text).rlike(rule.pattern), found).otherwise(empty)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``, array<struct<start, rule, end>> in code points, end exclusive, sorted; rule is a number in ``rules``.

    A null or empty text has no spans.  Whole texts are searched.  Rows meet
    their candidates by a hash of key and text, so rows with equal or null keys
    are spread, and keep their own texts and results.  A column ``out`` of
    ``df`` is replaced; others may have any names.
    """
    df = df.drop(out)
    row, whole, candidate, met = fresh(df, "row", "whole", "candidate", "met")
    docs = df.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(row, F.xxhash64(key, whole))
    index = postings(docs.select(F.col(row).alias(K), F.col(whole).alias(T)), rules)
    found = candidates(index, rules).select(F.col(K).alias(candidate), F.col("rules").alias(met))
    # The candidates are the build side; texts stream past it unsorted.
    joined = docs.join(found.hint("shuffle_hash"), F.col(row) == F.col(candidate), "left")
    empty = F.array().cast(SPANS)
    per_rule = [
        _spans(whole, rule, number) if rule.query is None else F.when(F.array_contains(met, number), _spans(whole, rule, number)).otherwise(empty)
        for number, rule in enumerate(rules)
    ]
    return joined.withColumn(out, F.array_sort(F.concat(*per_rule))).drop(row, whole, candidate, met)


def spans_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"], s["end"])), ",")


def secrets_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_assign, n_access, n_hex, base_sha256 of the base spans, spans (all kinds), n_added."""
    found = find_secrets(df.select(F.col(key), F.col(text)), RULES, key, text)

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("long")

    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    added = F.size(F.filter("spans", lambda s: s["rule"] >= len(BASE))).cast("long").alias("n_added")
    return found.select(key, *counts, F.sha2(spans_text(base, RULES), 256).alias("base_sha256"), spans_text(F.col("spans"), RULES).alias("spans"), added)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = REDACTED, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``, overlapping spans by one; a null text stays null.

    All other columns stay as they are, whatever their names.  The text is
    worked through in chunks, so a long one costs its length, not its square.
    """
    (spans,) = fresh(df, "spans")
    found = find_secrets(df, rules, key, text, spans)

    def clean(chunk: Column, number: Column) -> Column:
        base = number * CHUNK

        def step(so_far: Column, s: Column) -> Column:
            shown = F.concat(so_far["out"], F.substring(chunk, so_far["at"] - base + 1, s["start"] - so_far["at"]), F.lit(mark))
            return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.when(s["start"] >= so_far["at"], shown).otherwise(so_far["out"]).alias("out"))

        own = F.filter(spans, lambda s: (s["start"] < base + F.length(chunk)) & (s["end"] > base))
        return F.aggregate(own, F.struct(base.alias("at"), F.lit("").alias("out")), step, lambda x: F.concat(x["out"], F.substring(chunk, x["at"] - base + 1, F.lit(CHUNK))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    cleaned = F.array_join(F.transform(chunks, clean), "")
    return found.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(F.col(text))).select(*df.columns)


def report_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``secrets_report``: every rule scans every text."""
    columns, parts = [], []
    for n, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        columns.append(f"regexp_extract_all(t, {p}, 0) AS m{n}, regexp_extract_all(t, {p}, {r.group}) AS g{n}, string_split_regex(t, {p}) AS b{n}")
        begin = f"CAST(coalesce(list_sum(list_transform(b{n}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
        parts.append(f"list_transform(list_filter(range(1, len(m{n}) + 1), lambda i: length(g{n}[i]) >= {r.least}), lambda i: {{'a': {begin}, 'k': {n}, 'b': {begin} + length(m{n}[i])}})")
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    said = f"list_transform({{}}, lambda x: {names}[x.k + 1] || ':' || x.a || ':' || x.b)"
    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.k = {n})) AS BIGINT) AS n_{r.kind}" for n, r in enumerate(BASE))
    joined = reduce(lambda a, b: f"list_concat({a}, {b})", parts)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), e AS (SELECT doc_id, {', '.join(columns)} FROM d), "
        f"f AS (SELECT doc_id, list_sort({joined}) AS s FROM e) "
        f"SELECT doc_id, {counts}, sha256(array_to_string({said.format(f'list_filter(s, lambda x: x.k < {len(BASE)})')}, ',')) AS base_sha256, "
        f"array_to_string({said.format('s')}, ',') AS spans, CAST(len(list_filter(s, lambda x: x.k >= {len(BASE)})) AS BIGINT) AS n_added FROM f"
    )
