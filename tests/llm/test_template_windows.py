"""Leaks against a plain matcher that compares every window of every item with every window of every document."""

import random
import re

from skyledger.llm import decontamination as d

NAMES = ["Alice", "Bob", "Carol", "Dan"]


def tokens(text):
    """(word, kind) by the rules as they are stated."""
    out = []
    for line in text.split("\n"):
        fresh = True
        for raw in line.split(" "):
            if not raw:
                continue
            bare = re.sub(r"[!-/:-@\[-`{-~]", "", raw)
            if bare:
                low = bare.lower()
                if low.isdigit() or low in d.NUMBER_WORDS:
                    kind = "num"
                elif low in d.UNITS and out and out[-1][1] == "num":
                    kind = "unit"
                elif raw[0].isupper() and sum(c.isupper() for c in raw) == 1 and not fresh and len(raw) > 1:
                    kind = "name"
                else:
                    kind = "word"
                out.append((low, kind))
            fresh = raw[-1] in ".!?:"
    return out


def windows(item, doc, size=8, literals=4):
    """How many pairs of windows match with slots that stand for one value each."""
    k, n = min(size, len(item)), 0
    for j in range(len(item) - k + 1 if k else 0):
        a = item[j : j + k]
        template = sum(kind == "word" for _, kind in a) >= literals
        for s in range(len(doc) - k + 1):
            b = doc[s : s + k]
            if template:
                same = all(x[1] == y[1] and (x[1] != "word" or x[0] == y[0]) for x, y in zip(a, b, strict=True))
            else:
                same = [x[0] for x in a] == [y[0] for y in b]
            if not same:
                continue
            to, back, ok = {}, {}, True
            for (x, kind), (y, other) in zip(a, b, strict=True):
                if kind != "word":
                    y = y if kind == other else x
                    ok &= to.setdefault((kind, x), y) == y and (kind == "num" or back.setdefault((kind, y), x) == x)
            n += ok
    return n


def sentence(r):
    words = [f"w{r.randrange(30)}x" for _ in range(r.randint(6, 16))]
    for i in range(1, len(words)):
        u = r.random()
        if u < 0.15:
            words[i] = str(r.randrange(4))
        elif u < 0.3:
            words[i] = r.choice(NAMES)
        elif u < 0.4 and words[i - 1].isdigit():
            words[i] = r.choice(["km", "hours"])
    return " ".join(words) + r.choice([".", "?", ","])


def changed(r, text):
    """Numbers, names and units replaced, mostly one for one."""
    to = {x: r.choice(["7", "8", "9"]) for x in "0123"} | dict(zip(NAMES, r.sample(["Eve", "Frank", "Gina", "Hal"], 4), strict=True)) | {"km": "miles", "hours": "days"}
    parts = [to.get(w.rstrip(".?,"), w.rstrip(".?,")) + w[len(w.rstrip(".?,")) :] for w in text.split(" ")]
    if r.random() < 0.3:
        parts[r.randrange(len(parts))] = r.choice(["5", "Zoe", "word"])
    return " ".join(parts)


def test_equals_plain_matching(spark):
    r = random.Random(21)
    items = [" ".join(sentence(r) for _ in range(r.randint(1, 3))) for _ in range(25)] + ["one two", "12 + 7 = 19 or 20", "Alice", ""]
    docs = []
    for i in range(120):
        parts = [sentence(r) for _ in range(r.randint(1, 4))]
        if i % 2:
            parts.insert(r.randrange(len(parts) + 1), r.choice([lambda t: t, lambda t: changed(r, t)])(r.choice(items)))
        docs.append((i, r.choice([" ", "\n"]).join(parts)))
    docs += [(500, None), (501, ""), (502, "well Alice said"), (503, "then one two three")]
    want = {(i, k): n for i, t in docs for k, x in enumerate(items) if (n := windows(tokens(x), tokens(t or "")))}
    got = {(x.doc_id, x.item_id): x.windows for x in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) > 60 and got == want
    kept = {x.doc_id for x in d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
