"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must hold (as in code search: alternatives give OR, concatenation gives
AND). The index holds a posting (trigram, doc_id) for every document and every
trigram that some rule asks for; intersecting postings gives each rule's candidate
documents, and only those are searched with the rule's expression. A rule whose
matches need not hold any trigram, such as a run of hex digits, scans every text.

Trigrams are of texts with A-Z lower-cased, so candidates may be too many, never too few.
Native throughout: the index, the intersection and the search are DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import ascii_lower, let, materialize, small_enough, spare, table

#: Candidate doc_ids are broadcast up to this number (8 bytes each and a mask); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: letters match in either case
    fold: bool = False
    #: a match counts only if this group has so many characters
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    # a shorter run holds no longer match, so the least length can stand in the expression
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A Boolean query: None is true of any text, a str is a trigram, else ("and" | "or", queries).
ALL = None


def _join(kind: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not ALL]
        if not parts:
            return ALL
    elif ALL in parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    """What holds of a text that holds one of the strings. A string that holds another adds nothing."""
    shortest = [s for s in sorted(strings) if not any(t != s and t in s for t in strings)]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in shortest])


def trigram_query(pattern: str, most: int = 32):
    """The Boolean trigram query that every match of pattern fulfils; None if any text may match.

    Works on the parsed expression: a set of the exact strings that the last few
    nodes can spell is carried along while it is small, and turned into trigrams
    where an unbounded or wide node ends it.
    """

    def spelled(node) -> set[str] | None:
        """The few exact strings of a node, or None."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower() if chr(arg).isascii() else chr(arg)}
        if op is sre.IN:
            out = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out |= spelled((kind, x))
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    out |= {c for i in range(x[0], x[1] + 1) for c in spelled((sre.LITERAL, i))}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return strings_of(arg[3])
        if op is sre.BRANCH:
            sets = [strings_of(x) for x in arg[1]]
            return None if any(x is None for x in sets) else set().union(*sets)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
            once = strings_of(arg[2])
            if once is not None:
                out, now = set(), {""}
                for i in range(arg[1] + 1):
                    if i >= arg[0]:
                        out |= now
                    now = {a + b for a in now for b in once}
                    if len(now) > most:
                        return None
                return out
        return None

    def strings_of(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            one = spelled(node)
            if one is None or len(out) * len(one) > most:
                return None
            out = {a + b for a in out for b in one}
        return out

    def query(nodes):
        parts, run = [], {""}
        for node in nodes:
            one = spelled(node)
            if one is not None and len(run) * len(one) <= most:
                run = {a + b for a in run for b in one}
                continue
            parts.append(_of_strings(run))
            run = one if one is not None else {""}
            if one is None:
                op, arg = node
                if op is sre.SUBPATTERN:
                    parts.append(query(arg[3]))
                elif op is sre.BRANCH:
                    parts.append(_join("or", [query(x) for x in arg[1]]))
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    parts.append(query(arg[2]))
        return _join("and", [*parts, _of_strings(run)])

    return query(sre_parser.parse(pattern))


def trigrams_of(query) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(x) for x in query[1]))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram int, doc_id): the number of each given trigram that a row's text holds, once a row."""
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    held = lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(i)) for i, x in enumerate(trigrams)]), lambda i: i.isNotNull())
    return docs.select("doc_id", F.explode(let(low, held)).alias("trigram"))


def candidates(docs: DataFrame, rules) -> DataFrame:
    """(doc_id, rules long): a bit for each rule whose trigram query the document fulfils; documents without any are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted(set().union(*map(trigrams_of, queries)))
    words = [f"m{i}" for i in range(0, len(names), 62)] or ["m0"]
    # the postings of a document meet as bits, so that lists of any length merge with partial aggregation
    sets = postings(docs, names).groupBy("doc_id").agg(
        *[F.bit_or(F.when(F.floor(F.col("trigram") / 62) == i, F.expr(f"shiftleft(1L, trigram - {62 * i})")).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)]
    )

    def fulfilled(query) -> Column:
        if isinstance(query, str):
            i = names.index(query)
            return F.col(words[i // 62]).bitwiseAND(F.lit(1 << i % 62)) != 0
        tests = [fulfilled(x) for x in query[1]]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if query[0] == "and" else out | t
        return out

    bits = F.lit(0).cast("bigint")
    for i, q in enumerate(queries):
        if q is not ALL:
            bits = bits.bitwiseOR(F.when(fulfilled(q), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return sets.select("doc_id", bits.alias("rules")).filter("rules != 0")


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in text: array<struct<start, ord, stop, kind>>, in code points, the stop exclusive.

    Where a text's pieces between the matches begin and end gives the positions.
    """
    pattern = ("(?i)" if rule.fold else "") + rule.pattern
    kind = "struct<start:int,ord:int,stop:int,kind:string>"
    none = F.array().cast(f"array<{kind}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))

    def placed(both: Column) -> Column:
        gaps, whole, part = both["gaps"], both["whole"], both["part"]

        def add(state: Column, i: Column) -> Column:
            start = state["at"] + F.char_length(F.get(gaps, i))
            stop = start + F.char_length(F.get(whole, i))
            one = F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
            keep = F.char_length(F.get(part, i)) >= rule.least
            return F.struct(stop.alias("at"), F.when(keep, F.concat(state["out"], F.array(one).cast(f"array<{kind}>"))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, add, lambda s: s["out"])

    place = lambda whole: F.when(F.size(whole) == 0, none).otherwise(let(F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), (measured if rule.group else whole).alias("part")), placed))
    return let(found, place)


def scan(docs: DataFrame, rules=BASE + MORE, *, broadcast_rows: int = BROADCAST_ROWS, into: str = "found") -> DataFrame:
    """docs with a column into: array<struct<start, ord, stop, kind>> by start, then the order of the rules.

    docs needs doc_id and text; its other columns stay, whatever their names, but for
    one named as into is. A null or empty text has no matches. Rows that share a
    doc_id, or have none, are searched each by itself, and repeated rows come out
    each. An empty table gives no rows. Matches of one rule don't overlap, those of
    several may.
    """
    docs = docs.drop(into)
    asked = [i for i, r in enumerate(rules) if trigram_query(r.pattern) is not ALL]
    text = F.coalesce(F.col("text"), F.lit(""))
    mask, name = spare(docs.columns, "rules"), spare(docs.columns, "_of")
    if asked:
        sets = materialize(candidates(docs, rules)).toDF(name, mask)
        # null-safe, as the postings of rows without an id are grouped under null
        docs = docs.join(F.broadcast(sets) if small_enough(sets, broadcast_rows) else sets, F.col("doc_id").eqNullSafe(F.col(name)), "left")
    parts = []
    for i, r in enumerate(rules):
        found = matches(text, r, i)
        parts.append(F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, found).otherwise(F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")) if i in asked else found)
    return docs.withColumn(into, F.array_sort(F.concat(*parts))).drop(mask, name)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, rules=BASE + MORE, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars (if there) counted anew; the same rows and columns.

    Overlapping secrets are replaced as one. A text without secrets stays as it is, a
    null text stays null. Rows without an id or that share one are redacted each by
    itself, repeated rows stay repeated, an empty table gives no rows.
    """
    names = docs.columns
    spans = spare(names, "_found")

    def cut(spans: Column) -> Column:
        def add(state: Column, s: Column) -> Column:
            apart = s["start"] >= state["at"]
            new = F.concat(F.col("text").substr(state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
            return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(apart, F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.col("text").substr(s["at"] + 1, F.char_length(F.col("text")))))

    new = F.when(F.size(spans) > 0, cut(F.col(spans))).otherwise(F.col("text"))
    out = scan(docs, rules, into=spans).withColumn("text", new)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base secrets, a digest of their places and the list of all spans for every whole document; null texts are empty."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op9_sql(rules=BASE + MORE) -> str:
    """The same in DuckDB: texts between matches give their places, as in matches()."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(rules):
        pattern = q(("(?i)" if r.fold else "") + r.pattern)
        kept = f"length(regexp_extract(m, {pattern}, {r.group})) >= {r.least}"
        parts.append(f"""SELECT n, start, {i} AS ord, start + length(m) AS stop, {q(r.kind)} AS kind FROM (
  SELECT n, m, coalesce(sum(length(gap) + length(before)) OVER w, 0)::BIGINT AS start FROM (
    SELECT n, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(list_prepend('', ms)[1:len(ms)]) AS before, generate_subscripts(ms, 1) AS turn FROM (
      SELECT n, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps FROM texts) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY n ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE {kept}""")
    base = f"ord < {len(BASE)}"
    listed_ = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    counts = ", ".join(f"count(*) FILTER (kind = {q(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
said AS (SELECT n, {counts}, coalesce({listed_} FILTER ({base}), '') AS base, {listed_} AS spans FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN said USING (n)"""
