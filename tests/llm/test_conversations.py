"""Conversation repair against a search through all edits, and the query against its SQL, with nulls, ties, repeated rows and long conversations."""

import hashlib
import heapq
import random
import re

import duckdb
import pytest

from skyledger.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault string, gone boolean, conv int"


def search(rows):
    """(cost, audit, repaired) of (role, text, fault) rows by uniform-cost search through single edits; states are kept with the roles so far."""
    heap, done = [(0, "", 0, "")], set()
    best = None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if (i, roles[-2:], len(roles)) in done and best is not None:
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit)
            continue
        if len(audit) > 2 * len(rows) + 4 or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(rows):
            role, _, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1])) if role[:1] else None
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, roles + r))
    return best


def written(rows, audit):
    """The repaired text that an audit gives."""
    out, i = [], 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        k = len(out) - (bool(out) and out[0].startswith("s"))
        due = "user" if k % 2 == 0 else "assistant"
        out.append(f"{rows[i][0]}:{rows[i][1]}" if e == "K" else f"{due}:" if e == "I" else f"{due}:{rows[i][1]}")
        i += e != "I"
    return "\n".join(out)


def table(seed=3, conversations_=60):
    r = random.Random(seed)
    rows = []
    for c in range(conversations_):
        for t in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", None, "tool"])
            rows.append((c if c else None, r.choice([t, t, t + 1, None]), role, r.choice(["Hello.", "Hello.", "cut", "", None, " \t", f"No {t}! \n", "tail.\n x"])))
    return rows


def test_all_edits(spark):
    rows = table()
    df = spark.createDataFrame([(*r, "x", False, 7) for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, g in got.items():
        own = sorted(((t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marked = set(), []
        for _, role, text in own:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        assert g.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [g.blank, g.duplicate, g.truncated] == [sum(f == n for _, _, f in marked) for n in ("blank", "duplicate", "truncated")]
        assert g.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        assert (g.cost, g.audit) == search(marked), marked
        assert g.repaired_sha256 == hashlib.sha256(written(marked, g.audit).encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_its_sql(spark, tmp_path, seed):
    rows = table(seed, 80) + [(500, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(700)] + [(501, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(conversations.oracle())
    names = [d[0] for d in want.description]
    got = conversations.op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_long_conversation_stays_small(spark):
    """What all audits share is handed over, so a long conversation costs no square of its length."""
    chart = conversations.Chart()
    for i in range(30_000):
        chart.scan(("user", "assistant")[i % 2], f"{i}.", False, i % 1000 == 7)
        assert max(len(v.audit) for v in chart.column.values()) < 3 * conversations._SETTLED
    cost, audit, _ = chart.repair()
    assert audit.count("D") >= 30 and cost >= 4 * 30 and len(audit) >= 30_000


def test_none_and_gone(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(none).count() == 0 and conversations.repair(conversations.damage(none), gone_col="gone").count() == 0
    gone = spark.createDataFrame([("a", 1, "user", "x", True)], "conv_id string, turn long, role string, text string, gone boolean")
    row = conversations.repair(gone, gone_col="gone").first()
    assert tuple(row) == ("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
