"""Secret scans: Boolean trigram queries derived from each rule's pattern pick candidates from a trigram index; the pattern verifies them."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import read, text_of


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share; a match counts if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in the order in which they are listed. The bounds of access and
#: hex stand in their patterns: as both end in one greedy run, a shorter match hides no longer one.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds of this operator.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> tuple:
    """("all", parts) or ("any", parts) over lower-case trigrams that every match holds; ("all", ()) says nothing.

    Runs of literals give their trigrams, alternatives an "any", parts that may be missing nothing.
    """

    def walk(nodes) -> tuple:
        parts, run = [], ""

        def close():
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in nodes:
            if op is sre.LITERAL:
                run += chr(arg).lower()
            elif op is sre.SUBPATTERN:
                close()
                parts.append(walk(arg[3]))
            elif op is sre.BRANCH:
                close()
                some = [walk(x) for x in arg[1]]
                if all(x[1] for x in some):
                    parts.append(("any", tuple(some)))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                if len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
                    run += chr(arg[2][0][1]).lower() * min(arg[0], 8)
                    if arg[1] != arg[0]:
                        close()
                else:
                    close()
                    parts.append(walk(arg[2]))
            else:
                close()
        close()
        flat = []
        for x in parts:
            flat.extend(x[1] if isinstance(x, tuple) and x[0] == "all" else [x])
        return "all", tuple(dict.fromkeys(flat))

    return walk(parser.parse(pattern))


def trigrams(query) -> list[str]:
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(t for part in query[1] for t in trigrams(part)))


def holds(query, has) -> Column:
    """The query over has(trigram)."""
    if isinstance(query, str):
        return has(query)
    out = F.lit(True)
    for i, part in enumerate(query[1]):
        c = holds(part, has)
        out = c if i == 0 else (out & c if query[0] == "all" else out | c)
    return out


def wanted_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    wanted = list(dict.fromkeys(t for r in rules for t in trigrams(trigram_query(r.pattern))))
    if len(wanted) > 63:
        raise ValueError("more than 63 trigrams: scan the rules in several calls")
    return wanted


def with_trigrams(docs: DataFrame, wanted: list[str], text_col: str = "text") -> DataFrame:
    """docs with `has`: a bit for each of the wanted trigrams that the lower-cased text holds, which are the row's postings."""
    low = docs.withColumn("_low", F.lower(text_of(text_col)))
    has = F.lit(0).cast("long")
    for i, t in enumerate(wanted):
        has = has.bitwiseOR(F.when(F.contains("_low", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return low.withColumn("has", has).drop("_low")


def postings(docs: DataFrame, wanted: list[str], key: str, text_col: str = "text") -> DataFrame:
    """The inverted index of the wanted trigrams, for corpora that are scanned again: rows (trigram, key)."""
    some = with_trigrams(docs.select(F.col(key), F.col(text_col).alias("text")), wanted).where("has <> 0")
    hit = F.filter(F.transform(F.array(*map(F.lit, wanted)), lambda t, i: F.when(F.expr("has").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, t)), lambda t: t.isNotNull())
    return some.select(F.explode(hit).alias("trigram"), F.col(key))


def matching_rules(rules: tuple[Rule, ...], wanted: list[str]) -> Column:
    """A bit for each rule whose trigram query the postings `has` meet; rules without mandatory trigrams always have theirs."""
    has = lambda t: F.col("has").bitwiseAND(F.lit(1 << wanted.index(t))) != 0
    bits = F.lit(0)
    for i, r in enumerate(rules):
        q = trigram_query(r.pattern)
        bits = bits.bitwiseOR(F.when(holds(q, has), F.lit(1 << i)).otherwise(F.lit(0)) if q[1] else F.lit(1 << i))
    return bits


def _running(rows: Column, base: Column) -> Column:
    """(end, out) of rows (gap, m, g) that lie end to end from base: out holds their start, end and g."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,g:int>>)")
    return F.aggregate(
        rows,
        F.struct(base.cast("int").alias("at"), empty.alias("out")),
        lambda s, r: F.struct((s["at"] + r["gap"] + r["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + r["gap"]).alias("start"), (s["at"] + r["gap"] + r["m"]).alias("end"), r["g"].alias("g")))).alias("out")),
    )


def spans(text: str, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the leftmost matches of a rule, in code points; those with a short group are dropped.

    The pieces between matches and the matches themselves, both found by the same engine from the left,
    lie end to end, so their lengths give the places. They are added up in blocks of about the root of
    their number, so a text with very many matches costs no square of them. Patterns without
    look-around: a match by itself has the groups that it has in its text.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    group = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    gaps = F.split(F.col(text), rule.pattern, -1)
    sizes = lambda f, cut: F.zip_with(f, F.slice(cut, 1, F.size(f)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("m"), group(m).alias("g")))

    def walk(rows: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(rows))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / side).cast("int")), lambda i: F.slice(rows, i * side + 1, side))
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, r: n + r["gap"] + r["m"])
        begins = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, begins, lambda b, at: _running(b, at)["out"]))

    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    kept = lambda rows: F.transform(F.filter(walk(rows), lambda s: s["g"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    some = lambda f: F.when(F.size(f) > 0, F.element_at(F.transform(F.array(sizes(f, gaps)), kept), 1)).otherwise(none)
    return F.element_at(F.transform(F.array(found), some), 1)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, its text, and `found`: array of (start, order, end, kind), by start and then the kinds' order.

    Null text is the empty text, with no secret; an empty table gives no rows. Every row is scanned by
    itself, so rows of one id, or without id, need nothing from each other, and other columns of docs,
    whatever their names, are left out. A rule's pattern runs only where the row's postings meet its
    trigram query; a rule without mandatory trigrams (here hex) scans all rows. Nothing is shuffled.
    """
    wanted = wanted_trigrams(rules)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = with_trigrams(keyed, wanted).select("doc_id", "text", matching_rules(rules, wanted).alias("rules"))
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    found = [F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, spans("text", r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), F.array_sort(F.concat(*found)).alias("found"))


def op8_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: a row per row of documents with the counts and digest of the base kinds, and all spans. Null and empty texts have none; repeated rows each give theirs."""
    out = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return out.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> str:
    """DuckDB SQL of op8: every pattern over every whole text, places by sums of the pieces' lengths."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = "SELECT rid, doc_id, {k} AS k, {kind} AS kind, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap, unnest(g) AS g FROM (SELECT rid, doc_id, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, {group}) AS g FROM d)"
    parts = " UNION ALL ".join(f"SELECT * FROM ({one.format(k=i, kind=quoted(r.kind), p=quoted(r.pattern), group=r.group)}) WHERE length(g) >= 0" for i, r in enumerate(rules))
    least = "CASE k " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules)) + " END"
    base = len(BASE_RULES)
    counts = ", ".join(f"CAST(count(s.rid) FILTER (WHERE k = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    form = "kind || ':' || a || ':' || e"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
p AS (SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS e FROM m),
s AS (SELECT rid, k, kind, e - length(m) AS a, e FROM p WHERE length(g) >= {least})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({form}, ',' ORDER BY a, k) FILTER (WHERE k < {base}), '')) AS base_sha256, coalesce(string_agg({form}, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, doc_id"""
