"""Repair of conversations whose turns were lost, repeated or relabelled: error-correcting Earley parsing with a weighted grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import read

#: Roles by initial; a conversation may begin with a system turn, then users and assistants take turns.
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = {
    "conversation": ((), ("s", "turns"), ("turns",)),
    "turns": (("u", "reply"),),
    "reply": (("a",), ("a", "turns")),
}
RULES = [(name, body) for name, bodies in GRAMMAR.items() for body in bodies]
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated turn costs more, unless it is deleted.
TRUNCATED = 3
_BLANK = r"\x20\x09-\x0D"
#: From any item two inserts reach the end of an assistant's turn, and from there every continuation of any other item costs at most a delete more; so an item that costs more than this above the best one is on no best repair.
_HOPELESS = 2 * INSERT + DELETE
#: Audits longer than this hand over what all items have in common.
_SETTLED = 2048


class _Item:
    """A chart item's value: the least cost and audit of all repairs of the turns so far that end in it, and what they would write. The digest is made once the item has stayed in its column."""

    __slots__ = ("cost", "audit", "parent", "line", "digest", "lines")

    def __init__(self, cost: int, audit: str, parent: _Item | None, line: str | None):
        self.cost, self.audit, self.parent, self.line, self.digest, self.lines = cost, audit, parent, line, None, 0

    def settle(self) -> None:
        if self.digest is None:
            up = self.parent
            if up is None:
                self.digest, self.lines = hashlib.sha256(), 0
                return
            up.settle()
            self.digest, self.lines = up.digest, up.lines
            if self.line is not None:
                self.digest = up.digest.copy()
                self.digest.update(("\n" * (self.lines > 0) + self.line).encode(errors="surrogatepass"))
                self.lines += 1
            self.parent = self.line = None


class Chart:
    """An Earley chart, column by column.

    An item is a rule of the grammar with a dot in it. Nonterminals stand only at the end of a rule, so
    what completes above an item is settled when it is predicted (Leo's rule for right recursion): items
    need no origin, a column holds each dotted rule once, with the least (cost, audit) of all the turns so
    far, and no earlier column is kept; what costs too much to be on a best repair leaves it. Scanning a turn keeps it where its role's initial is the one
    expected; the error productions also rerole it to what is expected, delete it, or insert a turn.
    Of equal audits none is a beginning of another at the same cost, so ties settled early stay right.
    """

    def __init__(self):
        self.settled: list[str] = []
        self.column: dict[tuple[int, int], _Item] = {}
        start = _Item(0, "", None, None)
        self._close({(i, 0): start for i, (name, _) in enumerate(RULES) if name == "conversation"})

    @staticmethod
    def _put(column: dict, item: tuple[int, int], value: _Item) -> bool:
        old = column.get(item)
        if old is not None and (old.cost, old.audit) <= (value.cost, value.audit):
            return False
        column[item] = value
        return True

    def _close(self, column: dict[tuple[int, int], _Item]) -> None:
        """Predict what may follow and insert turns, until nothing gets cheaper."""
        work = list(column)
        while work:
            rule, dot = work.pop()
            value, body = column[rule, dot], RULES[rule][1]
            if dot == len(body):
                continue
            want = body[dot]
            if want in GRAMMAR:
                work += [(i, 0) for i, (name, _) in enumerate(RULES) if name == want and self._put(column, (i, 0), value)]
            elif want in ROLES and self._put(column, (rule, dot + 1), _Item(value.cost + INSERT, value.audit + "I", value, f"{ROLES[want]}:")):
                work.append((rule, dot + 1))
        least = min(v.cost for v in column.values())
        column = {item: v for item, v in column.items() if v.cost <= least + _HOPELESS}
        for value in column.values():
            value.settle()
        self.column = column
        if len(next(iter(column.values())).audit) > _SETTLED:
            shared = commonprefix([v.audit for v in column.values()])
            self.settled.append(shared)
            for value in {id(v): v for v in column.values()}.values():
                value.audit = value.audit[len(shared) :]

    def scan(self, role: str, text: str, truncated: bool, delete: bool) -> None:
        """A turn; delete: it has to go."""
        column: dict[tuple[int, int], _Item] = {}
        more = TRUNCATED if truncated else 0
        for (rule, dot), value in self.column.items():
            body = RULES[rule][1]
            self._put(column, (rule, dot), _Item(value.cost + DELETE, value.audit + "D", value, None))
            if delete or dot == len(body) or body[dot] in GRAMMAR:
                continue
            want = body[dot]
            if role[:1] == want:
                self._put(column, (rule, dot + 1), _Item(value.cost + KEEP + more, value.audit + "K", value, f"{role}:{text}"))
            elif want in ROLES:
                self._put(column, (rule, dot + 1), _Item(value.cost + REROLE + more, value.audit + "R", value, f"{ROLES[want]}:{text}"))
        self._close(column)

    def repair(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired turns): the best completed item."""
        cost, audit, best = min(((v.cost, v.audit, v) for (rule, dot), v in self.column.items() if dot == len(RULES[rule][1])), key=lambda x: x[:2])
        return cost, "".join(self.settled) + audit, best.digest.hexdigest()


class _Conversation:
    """Counts and chart of one conversation; all that is kept of it at a time."""

    def __init__(self, conv):
        self.conv, self.chart = conv, Chart()
        self.least = self.most = self.last = self.initial = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def take(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        self.chart.scan(role, text, fault == "truncated", fault in ("blank", "duplicate"))

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, *self.chart.repair())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """A row per conversation of turns: conv_col, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    A conversation's turns are taken in order of turn (nulls first), then role, then text. A turn is blank,
    else a duplicate of an earlier one with its role and text, else truncated (not ended by . ! or ?), or
    sound. The cheapest edits that make the roles' initials match (s?(ua)+)? are given by their initials:
    Keep costs 0, Rerole 3, Delete 4 (a must for blank and duplicate turns), Insert 3, a truncated turn
    that stays 3 more; of equal costs the smallest audit in ASCII counts. Null roles and texts are one
    space; turns without conversation make one of their own, whose id is null. Turns of equal
    conversation, turn, role and text are duplicates. gone_col: a boolean column, true for turns that only
    say that the conversation is there; one with no others has zeros, an empty audit and the digest of
    nothing. An empty table gives no rows; further columns are ignored.

    A conversation's turns meet in one task, as its digest runs over all of them; they stream through in
    order, and of a conversation only its chart's last column is kept, whatever its length.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), (F.col(gone_col) if gone_col else F.lit(False)).alias("gone"))
    kind = rows.schema["conv"].dataType.simpleString()
    # the window needs no exchange of its own
    earlier = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(~F.col("text").rlike(f"[^{_BLANK}]"), "blank").when(F.row_number().over(earlier) > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][{_BLANK}]*\z"), "truncated")
    rows = rows.repartition("conv").withColumn("fault", fault)
    rows = rows.sortWithinPartitions("conv", "gone", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * (1 + len(COLUMNS))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=["conv", *COLUMNS])

        now, conv_type = None, None
        for batch in batches:
            done, conv_type = [], batch.column("conv").type
            for conv, turn, role, text, gone, fault in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "gone", "fault")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                if not gone:
                    now.take(turn, role, text, fault)
            if done:
                yield table(done)
        if now is not None:
            yield table([now.row()])

    found = rows.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in COLUMNS))
    return found.withColumnRenamed("conv", conv_col)


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with a fault in five of twenty rows, by crc32 of `conv_id:turn`; nulls are one space. What is dropped stays as a row that is gone."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), n.alias("n"))
    copies = F.sequence(F.lit(1), F.when(F.col("n") == 3, 2).otherwise(1))
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("n") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(read(spark, sf_dir, "conversations")), gone_col="gone")


def oracle() -> str:
    """DuckDB SQL of op13: the same least (cost, audit) over the four states of the role automaton, turn by turn. A state's value is its cost in 12 digits, then its audit, so the least string is the best repair."""
    add = lambda v, cost, letter: f"lpad(((substr({v}, 1, 12))::BIGINT + {cost})::VARCHAR, 12, '0') || substr({v}, 13) || '{letter}'"
    closed = lambda p: f"{p}a AS a, {p}b AS b, least({p}c, {add(f'least({p}a, {p}b, {p}d)', 3, 'I')}) AS c, {p}d AS d"
    close = lambda src, keep: f"SELECT {keep}, a, b, c, least(d, {add('c', 3, 'I')}) AS d FROM (SELECT {keep}, {closed('')} FROM {src})"
    stay = f"CASE WHEN f = 3 THEN 3 ELSE 0 END"
    ok = "f IN (0, 3)"
    return f"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
raw AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS MATERIALIZED (SELECT k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(k)), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS n FROM (SELECT DISTINCT k, hex(encode(k)) AS h FROM raw), tab),
dm AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM raw JOIN crc USING (k), LATERAL (SELECT unnest(range(CASE WHEN n = 3 THEN 2 ELSE 1 END))) WHERE n <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dm),
fl AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
c AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations), st AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY 1),
dp AS (SELECT conv_id, 0::BIGINT AS i, '000000000000' AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d FROM c
  UNION ALL SELECT conv_id, i,
    {add('a', 4, 'D')},
    least({add('b', 4, 'D')}, CASE WHEN {ok} AND r = 's' THEN {add('a', stay, 'K')} END),
    least({add('c', 4, 'D')}, CASE WHEN {ok} AND r = 'u' THEN {add('least(a, b, d)', stay, 'K')} WHEN {ok} THEN {add('least(a, b, d)', '3 + ' + stay, 'R')} END),
    least({add('d', 4, 'D')}, CASE WHEN {ok} AND r = 'a' THEN {add('c', stay, 'K')} WHEN {ok} THEN {add('c', '3 + ' + stay, 'R')} END)
  FROM ({close('(SELECT dp.*, fl.i AS j, fl.f, fl.r FROM dp JOIN fl ON fl.conv_id IS NOT DISTINCT FROM dp.conv_id AND fl.i = dp.i + 1)', 'conv_id, j AS i, f, r').replace('SELECT conv_id, j AS i, f, r, a, b, c, least', 'SELECT conv_id, i, f, r, a, b, c, least')})),
fin AS MATERIALIZED (SELECT conv_id, least(a, d) AS v FROM ({close('(SELECT dp.* FROM dp LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(st.n, 0))', 'conv_id')})),
ed AS (SELECT conv_id, x.p, x.e FROM (SELECT conv_id, unnest(list_transform(range(1, length(v) - 11), lambda p: {{'p': p, 'e': substr(v, 12 + p, 1)}})) AS x FROM fin)),
em AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM ed),
wr AS (SELECT em.conv_id, em.p, em.e, em.k, fl.role, fl.text, max(CASE WHEN em.k = 1 AND em.e = 'K' AND fl.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY em.conv_id) AS lead FROM em LEFT JOIN fl ON fl.conv_id IS NOT DISTINCT FROM em.conv_id AND fl.i = em.i AND em.e <> 'I' WHERE em.e <> 'D'),
tx AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - 1 - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM wr GROUP BY 1)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, substr(v, 1, 12)::BIGINT AS cost, substr(v, 13) AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM fin LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN tx ON tx.conv_id IS NOT DISTINCT FROM fin.conv_id"""
