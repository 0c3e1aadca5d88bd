import random
import re
from collections import Counter, defaultdict

from quirefold.llm import templates as T


def read(text):
    """(template token, slot value or None) one after the other."""
    out, last = [], None
    b = (text or "").encode().decode("latin-1")
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", b):
        w = m[0]
        opens = last is None or re.search(r"[\n!.:?]", b[last : m.start()])
        low = re.sub("[A-Z]", lambda c: c[0].lower(), w)
        value = w.encode("latin-1").decode("utf-8", "replace").lower()
        if w[0].isascii() and w[0].isdigit():
            out.append(("<number>", value))
        elif out and out[-1][0] == "<number>" and low in T.UNITS:
            out.append(("<unit>", value))
        elif re.match("[A-Z]", w) and not opens and re.search(r"[a-z]", w):
            out.append(("<name>", value))
        else:
            out.append((low, None))
        last = m.end()
    return out


def grams(text):
    t = read(text)
    for i in range(len(t) - T.WINDOW + 1):
        w = t[i : i + T.WINDOW]
        if sum(v is None for _, v in w) >= T.SOLID:
            yield tuple(a for a, _ in w), tuple(v for _, v in w if v is not None)


def brute(docs, items):
    known, out = defaultdict(set), []
    for i, t in items:
        if i is not None:
            for g, s in grams(t):
                known[i].add((g, s))
    by_doc = defaultdict(set)
    for d, t in docs:
        if d is not None:
            by_doc[d] |= set(grams(t))
    for d, theirs in by_doc.items():
        for i, ours in known.items():
            hits = [(g, s, u) for g, s in ours for h, u in theirs if g == h]
            n = Counter()
            for o, t, _ in {(o, t, g) for g, s, u in hits for o, t in zip(s, u, strict=True)}:
                n[o, t] += 1
            keep = {(o, t) for o, t in n if all((-n[o, t], o, t) <= (-n[p, q], p, q) for p, q in n if p == o or q == t)}
            fine = {g for g, s, u in hits if all(x in keep for x in zip(s, u, strict=True))}
            size = len({g for g, _ in ours})
            if fine and len(fine) >= min(T.MATCHED, size):
                out.append((d, i, size, len(fine)))
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    item = lambda a, b, c: f"A {' '.join(words[:4])} when Anna gave {a} kg to {b} and then {c} more. {' '.join(words[4:12])}, so {b} has {a} kg; what does {b} do?"
    words = [word() for _ in range(14)]
    other = [word() for _ in range(30)]
    items = [(0, item(3, "Bob", "1.5")), (1, " ".join(other)), (2, "too short"), (3, None), (None, "x " * 20), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (1, " ".join(other))]
    docs = [
        (0, "intro " + item(3, "Bob", "1.5")), (1, item(7, "Carla", "2")), (2, item(7, "Carla", "2").replace("Carla has", "Dora has")),
        (3, " ".join(other[:13])), (4, " ".join(other[:12])), (5, re.sub("[a-z]", lambda c: c[0].upper(), " ".join(other)) + "!"), (6, None), (7, ""), (8, "9 8 7 6 5 4 3 2 1 2 3 4 5"),
        (9, "pad " * 30000 + " ".join(other)), (None, " ".join(other)), (10, " ".join(word() for _ in range(300))), (0, "intro " + item(3, "Bob", "1.5")),
    ]
    got = T.leaks(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id", "2 as hash"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {(d, i) for d, i, *_ in want} >= {(0, 0), (1, 0), (3, 1), (5, 1), (9, 1)} and not {d for d, *_ in want} & {4, 8, 10}
    kept = T.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 6, 7, 8, 10, None] + [2] * all(w[0] != 2 for w in want), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert T.leaks(docs, items).count() == 0
    assert T.leaks(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string"), items).count() == 0


def leaked(spark, docs, items):
    got = T.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_renamed_at_sentence_starts(spark):
    tom = "Tom has 12 apples. Tom gives 5 apples to Anna. How many apples does Tom have left?"
    ben = "Ben has 30 apples. Ben gives 8 apples to Mia. How many apples does Ben have left?"
    items = [(0, tom), (1, "The farmer sold three boxes of pears and then five more boxes to the market in town.")]
    docs = [
        (0, ben), (1, ben.lower()), (2, ben.upper()), (3, tom), (4, tom.lower()), (5, "A farmer sold seven boxes of pears and then two more boxes to the market in town."),
        (6, "The farmer sold 7 boxes of pears and then 2 more boxes to the market in town."), (7, "Ben has 30 apples. Kim gives 8 apples to Mia. How many pears will Joe have left?"), (8, ben.replace("30", "thirty")),
    ]
    assert leaked(spark, docs, items) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (8, 0)}


def test_two_versions_in_one_text(spark):
    pens = "In total 3 pens and 5 books cost how much money there"
    other = pens.replace("3", "7").replace("5", "2")
    mixed = pens.replace("3", "2").replace("5", "3")
    docs = [(0, f"{pens}. {other}."), (1, f"{other}\n" * 5 + mixed), (2, " ".join((pens, "x " * 50, mixed, other))), (3, pens.replace("5", "3"))]
    assert leaked(spark, docs, [(0, pens)]) == {(0, 0), (1, 0), (2, 0)}


def test_short_and_slot_heavy_items(spark):
    items = [(0, "Which river flows through the old town?"), (1, "What is 12 + 35 * 7 - 4 + 18?"), (2, "Who wrote Emma?"), (3, "9 + 8 - 7 * 6 + 5 - 4 + 3 * 2 - 1 = ?")]
    docs = [
        (0, "Ask: which river flows through the old town? Nobody knows."), (1, "so what is 12 + 35 * 7 - 4 + 18, please"), (2, "who wrote emma"), (3, "9+8-7*6+5-4+3*2-1"),
        (4, "What is 12 + 35 * 7 - 4 + 19?"), (5, "Who wrote Ulysses?"), (6, "Which river flows through the new town?"), (7, "1 2 3 4 5 6 7 8 9"),
    ]
    assert leaked(spark, docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3)}
