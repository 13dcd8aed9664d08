"""Each operator on a small table with nulls, empty, long and repeated texts and clashing columns, and on none; results against brute force."""

import base64
import hashlib
import random
import re

import pyarrow as pa
import pytest

from skyledger.llm import decontamination, fingerprints, licenses, minhash, mixing, secrets, sharding, substrings, toxicity, warc
from skyledger.llm.common import WORD, shared_dir
from skyledger.llm.components import components

SCHEMA = "doc_id long, text string, source string, size long, shard int, range int, lot int, score double, h long, a int, rules int"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdehilnorst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) + r.choice(["", "\n", ".\nThe end"]) for _ in range(60)]
    out += [out[3], out[3], out[3], "", None, " \t\n", "é" * 3000 + " 😀 x", "the same " * 2000]
    base = [r.choice(words) for _ in range(150)]
    for i in range(4):
        near = list(base)
        near[10 + 20 * i] = "changed"
        out.append(" ".join(near))
    out += [out[5] + " " + " ".join(base[20:60]), "token = 'abcdef123456' AKIA" + "A1" * 9 + " 😀 password:abc secret=" + "0f" * 15]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "b", "a", "c"][i % 4], 7, 1, 2, 3, 0.5, 1, 2, 3) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "no id here at all", None, 7, 1, 2, 3, 0.5, 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    assert sharding.shard_documents(none, shards=4).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows} and len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - 1.5 * sum(s for s, _ in targets)) < 1e-6
    for size, target in targets:
        assert abs(sum(r.taken for r in rows if (r.source_size, r.target) == (size, target)) - target) <= 0.03 * target + 10
    assert all(sum(r.shard_words) == r.taken for r in rows)
    assert mixing.mix_sources(none).count() == 0


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # goal 3165; a and null stop at 200 and 20; b and c share 2945 by 1 : 2
    assert got == pytest.approx({"a": 200.0, "b": 2945 / 3, "c": 2945 * 2 / 3, None: 20.0})


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    good = [" ".join(r.choice("red green blue grey pink".split()) for _ in range(20)) + "." for _ in range(60)]
    bad = [g + " you are a vile fool. more here." for g in good[:30]]
    model = toxicity.train(good + bad, [0] * 60 + [1] * 30, 0.2)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= x.score <= 1 for x in rows)
    out = toxicity.score_documents(spark.createDataFrame([(1, "red. A vile fool. blue"), (2, None), (3, "red blue.")], "doc_id long, text string"), model).collect()
    assert [x.predicted for x in out] == [1, 0, 0]
    s = out[0].worst_sentences[0]
    assert "red. A vile fool. blue"[s.start : s.end] == " A vile fool"
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.train([], [], 0.0).score("x") == 0.0


def test_near_duplicates(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    cls = {r.doc_id: r.class_id for r in rows}
    assert cls[60] == cls[61] == cls[62] == 3 and cls[68] == cls[69] == cls[70] == cls[71] == 68
    assert cls[None] is None and cls[63] == cls[64] == 63
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with more and more words changed lie around the threshold; the classes equal brute force, whatever the size of a block."""
    r = random.Random(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for j in r.sample(range(len(words)), r.randint(0, 5)):
            words[j] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = minhash.NearParams()
    idf = minhash.document_frequencies(df, p)
    sets = [dict(zip(h.tolist(), (n * idf[(h & (p.idf_slots - 1)).astype("int64")]).tolist(), strict=True)) for h, n in minhash.shingles(pa.array([t for _, t in rows]), p)]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = sum(min(w, sets[j][h]) for h, w in a.items() if h in sets[j])
            if both >= p.similarity * (sum(a.values()) + sum(sets[j].values()) - both):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    assert 3 < len(set(root)) < 140
    for size in (1 << 20, 1 << 12):
        assert [x.class_id for x in sorted(minhash.near_duplicates(df, minhash.NearParams(block_bytes=size)).collect())] == root


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    parent = {x: x for p in links for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.class_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for p in links if p[0] != p[1] for x in p}


def test_fingerprints(docs, none):
    rows = [r for r in fingerprints.fingerprints(docs).collect() if r.doc_id is not None]
    t = {i: x or "" for i, x in enumerate(texts())}
    # the order also holds the row without id, last, and document 2 twice
    order = sorted([*t, 2], reverse=True) + [None]
    t[None] = "no id here at all"
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order) if k != 2}

    def pieces(x):
        return set(re.findall("[^\n]{1,128}", x))

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in rows:
        if r.doc_id == 2:
            continue
        x, n = t[r.doc_id], t[after[r.doc_id]]
        edited = x[: len(x) - len(x) // 2] + n[: len(x) // 2]
        assert r.n_chars == len(x) and r.edited_sha256 == SHA(edited)
        assert r.near_edited == pytest.approx(like(pieces(x), pieces(edited))) and r.near_next == pytest.approx(like(pieces(x), pieces(n)))
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[3] == prints[60] == prints[61] != prints[4]
    assert fingerprints.fingerprints(none).count() == 0


def test_larger_sketches(spark):
    a, b = [f"line {i}" for i in range(400)], [f"line {i}" for i in range(150, 900)]
    df = spark.createDataFrame([(2, "\n".join(a)), (1, "\n".join(b))], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(df).collect()}
    assert got[2] == pytest.approx(250 / 900)


def test_warc(spark):
    body = "é\r\n\r\nWARC/1.1\r\n" * 30000
    pages = spark.createDataFrame([(5, "u\nx", "abc", 1), (3, None, "abc", 1), (9, "v", None, 1), (8, "v", "", 1), (None, "v", "abc", 1), (1, "q", body, 1)], "page_id long, url string, html string, holder int")
    manifest = warc.write_archives(pages, f"{shared_dir(spark)}/warc-test-{random.random()}")
    rows = warc.chunk_table(manifest).collect()
    last = {r.page_id: r for r in rows if r.last}
    assert {k: (r.record_type, r.refers_to) for k, r in last.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 8), 8: ("response", None), None: ("response", None), 1: ("response", None)}
    parts = sorted((r for r in rows if r.page_id == 1), key=lambda r: r.chunk_no)
    assert len(parts) > 1 and b"".join(bytes(r.chunk) for r in parts) == body.encode()
    assert last[1].digest_so_far == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    assert last[5].declared_bytes == 3
    empty = warc.write_archives(pages.limit(0), f"{shared_dir(spark)}/warc-test-{random.random()}")
    assert warc.chunk_table(empty).count() == 0


QUESTION = "A train travels 60 km in 2 hours and Alice waits for it near the big station while Bob reads. How far does Alice see the train go in 5 hours if she waits"


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short")], "item_id long, text string")
    other = QUESTION.replace("60", "75").replace("Alice", "Carol").replace("Bob", "Dan")
    mixed = other.replace("does Carol", "does Eve")
    df = spark.createDataFrame([(1, "Intro. " + QUESTION), (2, "x\n" + other + "."), (3, mixed), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.exact) for r in decontamination.find_leaks(df, bench).collect()}
    # document 3 names one person twice where the item has two: only the windows that hold both names are clean
    assert got == {1: (1, True), 2: (1, False), 3: (1, False)}
    assert [r.doc_id for r in decontamination.decontaminate(df, bench).orderBy("doc_id").collect()] == [4, 5]
    assert decontamination.find_leaks(docs, bench).count() == 0 and decontamination.find_leaks(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_secrets(docs, none):
    base = (secrets.BASE_RULES[0], secrets.Rule("access", r"AKIA[A-Z0-9]+", 0, 20), secrets.Rule("hex", r"[0-9a-f]+", 0, 24))
    t = {i: x or "" for i, x in enumerate(texts())} | {None: "no id here at all"}
    for r in secrets.scan_secrets(docs).collect():
        want = sorted((m.start(), k, m.end()) for k, rule in enumerate(base) for m in re.finditer(rule.pattern, t[r.doc_id]) if len(m.group(rule.group)) >= rule.least)
        assert [(s.start, s.order, s.end) for s in r.found if s.order < 3] == want
    assert secrets.scan_secrets(none).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z]+") == ("all", ("aki", "kia"))
    assert secrets.trigram_query("[0-9a-f]{24,}") == ("all", ())
    assert secrets.trigram_query("(?:abcd|efg)x?") == ("all", (("any", (("all", ("abc", "bcd")), ("all", ("efg",)))),))


def test_licenses(spark, docs, none):
    mit = licenses.KNOWN_TEXTS[0][1]
    df = spark.createDataFrame([(1, "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + mit.upper()), (2, None), (3, "x\nLicensed under the Apache Licence, version 2.0\ny"), (4, mit + " but not really")], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.whole, r.lines) for r in licenses.find_licenses(df).collect()}
    assert got == {(1, "MIT", True, 0), (3, "Apache-2.0", False, 1)}
    assert licenses.find_licenses(docs).count() == 0 and licenses.find_licenses(none).count() == 0


def test_substrings(docs, none):
    t = {i: x or "" for i, x in enumerate(texts())} | {None: "no id here at all"}
    seen, want = {}, {None: (5, 0, t[None])}
    for i in sorted(k for k in t if k is not None):
        w = re.findall(WORD, t[i])
        keys = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {q for j, k in enumerate(keys) if seen.get(k, i) < i for q in range(j, j + 13)}
        for k in keys:
            seen.setdefault(k, i)
        want[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    for r in substrings.remove_repeats(docs).collect():
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
    assert substrings.remove_repeats(none).count() == 0


def test_automaton(spark):
    r, ref = random.Random(2), ["abcbc", "bcab", "bb"]
    automaton = substrings.SuffixAutomaton([list(x) for x in ref])
    for _ in range(100):
        q = "".join(r.choice("abc") for _ in range(9))
        assert automaton.statistics(list(q)) == [max(n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in x for x in ref)) for i in range(9)]
    a = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x c d e f y"), (2, "h i j")], "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed) for x in substrings.remove_reference_spans(a, b, least=3).collect()}
    assert got == {1: ("a b g", 7), 2: ("", 0)}
