import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from quirefold.llm import chat_tree as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rng = random.Random(4)
    say = lambda: rng.choice(["hi", "Ünï <|im_end|>", "a\\b\\\\<\\|x", "ok then", "", "日本", "<|endoftext|>"])
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            out.append((c, t * 2, rng.choice(["user", "assistant"]) if t else "system", say() if t > 1 else "shared"))
    return out + [(70, 0, None, None), (71, 0, "a\nb\\n", "x"), (72, 1, "user", "tie"), (72, 1, "user", "tie"), (72, 1, "assistant", "tie"), (None, 0, "user", "lost"), (73, 0, "assistant", "long " * 50000)]


def ordered(data):
    by = {}
    for c, t, r, x in data:
        if c is not None:
            by.setdefault(c, []).append((t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip_and_tree(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as k1", "3 as rank")
    tree, turns = C.build(df.repartition(5), PATH)
    got = {r.conv_id: r for r in C.read_back(tree, turns, PATH).collect()}
    want = ordered(data)
    assert set(got) == set(want)
    for c, ts in want.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(ts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len("".join(C.render(a, b))) for a, b in ts)
    nodes = sorted(tree.collect(), key=lambda r: r.start)
    assert len(nodes) == len({tuple(ts[: k + 1]) for ts in want.values() for k in range(len(ts))})
    assert all(a.start + a.n_tokens == b.start for a, b in zip(nodes, nodes[1:], strict=False)) and nodes[0].start == 0
    # depth first: following the stream with a stack meets each node right under its parent; intervals are its ancestors
    model, stack = Tokenizer.from_file(PATH), []
    paths = set()
    for n in nodes:
        stack = stack[: n.depth - 1]
        assert len(stack) == n.depth - 1 and n.position == sum(s.n_tokens for s in stack)
        assert {p for i in n.attends for p in range(i["from"], i["to"])} == {p for s in stack for p in range(s.start, s.start + s.n_tokens)}
        stack.append(n)
        paths.add(tuple(C.parse(model.decode(s.head + s.body + s.tail, skip_special_tokens=False)) for s in stack))
    assert paths == {tuple(ts[: k + 1]) for ts in want.values() for k in range(len(ts))}


def test_empty_table(spark):
    tree, turns = C.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH)
    assert tree.count() == 0 and C.read_back(tree, turns, PATH).count() == 0
