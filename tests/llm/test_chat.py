import hashlib
import random

import duckdb

from weft.llm.chat import SAID, chained, digests, format_paths, masked_text, op7_chat, paths, read_turns, write_turns

SF = "/root/testdata/sf0.001"


def test_round_trip():
    r = random.Random(3)
    for _ in range(400):
        turns = [("".join(r.choices("ab:#\\< \n", k=r.randint(0, 5))) if r.random() < 0.5 else "assistant", "".join(r.choices("\\#</turn>\n: é", k=r.randint(0, 12)))) for _ in range(r.randint(0, 4))]
        text, mask = write_turns(turns)
        assert read_turns(text) == turns
        assert masked_text(text, mask) == "".join(t for role, t in turns if role == "assistant")
    text, mask = write_turns([("user", SAID), ("assistant", SAID)])
    assert text.count("</turn>\n") == 2 and text.count("### ") == 2 and masked_text(text, mask) == SAID


def test_paths_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in range(30):
        for m in range(r.randint(1, 25)):
            rows.append((c, m, r.choice([None, m, 999] if m == 0 else [r.randrange(m)] * 9 + [None]), "user" if m % 2 else "assistant", f"t{m}", r.choice([None, 0.5, 1.0, 3.0])))
    rows += [(77, 1, 2, "user", "ring", 1.0), (77, 2, 1, "user", "ring", 1.0)]
    rows += [(78, i, i - 1, "user", str(i), 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    by = {}
    for c, m, p, _, _, s in rows:
        by.setdefault(c, {})[m] = (p, s or 0.0)
    want = {}
    for c, tree in by.items():
        parent = {m: (p if p in tree and p != m else None) for m, (p, _) in tree.items()}
        found = []
        for leaf in set(tree) - set(parent.values()):
            chain, at = [], leaf
            while at is not None:
                chain.append(at)
                at = parent[at]
            found.append((-sum(tree[m][1] for m in chain), leaf, chain))
        for n, (_, leaf, chain) in enumerate(sorted(found)[:2]):
            want[c, leaf] = (n + 1, chain[::-1])
    got = {}
    for x in paths(spark, df.select("conv_id", "msg_id", "parent_id", "score"), 2).collect():
        got.setdefault((x.conv_id, x.leaf, x.rank), []).append((-x.up, x.msg_id))
    assert {(c, leaf): (k, [m for _, m in sorted(p)]) for (c, leaf, k), p in got.items()} == want
    assert format_paths(spark, df.limit(0)).count() == 0
    one = {(x.conv_id, x.leaf): x.formatted for x in format_paths(spark, df, 1).collect()}
    assert [t for _, t in read_turns(one[78, 199])] == [str(i) for i in range(200)]


def test_query(spark):
    out = {r.conv_id: r for r in op7_chat(spark, SF).collect()}
    rows = duckdb.sql(f"select conv_id, role, coalesce(text, '') from '{SF}/conversations.parquet' order by conv_id, turn").fetchall() + [(-7, "user", SAID), (-7, "assistant", SAID)]
    want = {}
    for c, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert set(out) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].loss_chars) == (len(turns), len(loss))
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_cases(spark):
    df = spark.createDataFrame([(1, 0, "user", None, 5), (1, 0, None, "x" * 200_000, 5), (1, None, "assistant", "a", 5), (1, 0, "user", None, 5), (None, 1, "user", "y", 5)], "conv_id long, turn long, role string, text string, leaf int")
    out = {r.conv_id: r for r in digests(format_paths(spark, chained(df))).collect()}
    assert set(out) == {1} and out[1].n_turns == 4 and out[1].loss_chars == 1
