import hashlib
import math
import random
import re
from functools import lru_cache

import duckdb

from weft.llm import credentials as c
from weft.llm.credentials import find, guess_cost, op3_secrets, scan

SF = "/root/testdata/sf0.001"


def brute_base(t):
    spans = []
    for kind, p, ok in (("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
                        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(p, t) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


TEXTS = ["", None, "secret=token:\"abcdefgh\" x", "PassWord = 'x1y2z3w4' and api_key: short", "é" * 9 + " AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "AKIAAKIA" + "B" * 13,
         "toKen=abcdefgh", "my password is Kx9#vQ2!pLm8 ok", "password: password1", "pwd=aaaaaaaaaaaaaaaa", "https://bob:Zt7!kkW0qP@host/x", "f" * 23, "x" + "f" * 24,
         "passphrase = \"qwertyuiop123456\"", "a" * 300_000 + " token=9fK2mQ8vX1 " + "b" * 1000, "token  token=abc.def  token"]


def test_base_matches_brute_force_and_method_adds(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "s")], "doc_id long, text string, spans string")
    out = scan(df).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        t = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        base = brute_base(t)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("guess")) == base
        assert r.n_assign + r.n_access + r.n_hex == (base.count(",") + 1 if base else 0)
    assert scan(df.limit(0)).count() == 0


def test_guess_cost():
    assert guess_cost("password1") < 4 and guess_cost("aaaaaaaaaaaa") < 4 and guess_cost("qwertyuiop") < 5 and guess_cost("P@ssw0rd2019") < 6
    assert guess_cost("abcabcabcabc") < 6 and guess_cost("31/12/1999") < 6
    assert guess_cost("Kx9#vQ2!pLm8") > 12 and guess_cost("") == 0
    assert guess_cost("zq7kd0" * 1) <= sum(guess_cost(c) for c in "zq7kd0") + 1e-9
    got = {k: v for t in TEXTS if t for k, v in [(t, [s for s in find(t) if s[0] == "guess"])]}
    assert got["my password is Kx9#vQ2!pLm8 ok"] == [("guess", 15, 27)]
    assert got["https://bob:Zt7!kkW0qP@host/x"] and not got["password: password1"] and not got["pwd=aaaaaaaaaaaaaaaa"] and not got["passphrase = \"qwertyuiop123456\""]


@lru_cache(maxsize=None)
def exhaustive(value):
    """Least cost over every segmentation: each substring is priced by every rule that fits it as a whole."""
    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            part, low = value[i:j], value[i:j].lower()
            plain, prices = low.translate(c._LEET), []
            if len(part) == 1:
                prices.append(c._alphabet(part))
            rank = next((c.WORDS.index(w) + 1 for w in (low, plain) if w in c.WORDS), None)
            if rank:
                swaps = 0 if low in c.WORDS else sum(a != b for a, b in zip(low, plain))
                prices.append(math.log10(rank + 1) + math.log10(1 + (part != low) + swaps) + math.log10(2))
            if re.fullmatch(r"(19|20)\d\d", part):
                prices.append(math.log10(200) + math.log10(2))
            if re.fullmatch(r"\d{4}([-/.]?)(0[1-9]|1[0-2])\1(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])([-/.]?)(0[1-9]|1[0-2])\5(19|20)\d\d", part):
                prices.append(math.log10(200) + math.log10(365) + math.log10(2))
            for u in range(1, len(part) // 2 + 1):
                if len(part) % u == 0 and part == part[:u] * (len(part) // u) and (part[:u] * 2).find(part[:u], 1) == u:
                    prices.append(exhaustive(part[:u]) + math.log10(len(part) // u) + math.log10(2))
            steps = []
            for a, b in zip(low, low[1:]):
                p, q = c._KEYS.get(a), c._KEYS.get(b)
                near = (q[0] - p[0], q[1] - p[1]) if p and q and max(abs(q[0] - p[0]), abs(q[1] - p[1])) == 1 else None
                steps.append(near or ((9, ord(b) - ord(a)) if abs(ord(b) - ord(a)) == 1 and a.isalnum() and b.isalnum() else None))
            if len(part) >= 4 and None not in steps:
                prices.append(math.log10(36) + sum(a != b for a, b in zip(steps, steps[1:])) * math.log10(8) + math.log10(len(part)) + math.log10(2))
            if prices:
                best[j] = min(best[j], best[i] + min(prices))
    return best[-1]


def test_guess_cost_is_the_least_of_all_segmentations():
    r = random.Random(5)
    parts = ["password", "P4ss", "dragon", "asdfg", "qwerty", "house", "1999", "2001-02-03", "31121999", "ab", "aaa", "k3x9q", "zq", "x", "7", "!", "Ü", "abcd", "4321", "fgh", "sunshine", "-"]
    values = ["asdfghouse", "k3x9q" * 3, "aaaaaa", "passwordpassword", "qwertyqwertyqwerty", "abab" * 4 + "c", "asasasasas", "20012001", "1" * 12, "abcdefgfedcba", "", "a", "P@ssw0rdP@ssw0rd"]
    values += ["".join(r.choice(parts) * r.choice((1, 1, 1, 2, 3)) for _ in range(r.randint(1, 4)))[:26] for _ in range(250)]
    values += ["".join(r.choices("abs1", k=r.randint(1, 14))) for _ in range(250)]
    for v in values:
        assert abs(guess_cost(v) - exhaustive(v)) < 1e-9, (v, guess_cost(v), exhaustive(v))
    assert guess_cost("asdfghouse") < 6 and guess_cost("k3x9q" * 3) < c.LEAST_COST < guess_cost("k3x9q7Rv")
    assert guess_cost("a" * 5000) < 7 and guess_cost("as" * 300) < 9
    assert guess_cost("zebra", ("zebra",)) < 1 < guess_cost("zebra")


def test_no_bound_on_names(spark):
    for n in (1, 64, 65, 5000):
        assert [s[0] for s in find("https://" + "u" * n + ":Zt7!kkW0qP@host/x")] == ["guess"]


def test_query(spark):
    rows = {r.doc_id: r for r in op3_secrets(spark, SF).collect()}
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        assert rows[i].base_sha256 == hashlib.sha256(brute_base(t or "").encode()).hexdigest()
