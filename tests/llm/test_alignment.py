import hashlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from weft.llm import alignment
from weft.llm.alignment import align, aligned_texts, byte_vocabulary, library_encoder, op11_alignment, pair_counts, piece_vocabulary

SF = "/root/testdata/sf0.001"


def test_both_encoders_agree():
    path = f"{alignment.FOLDER}/{alignment.BYTE_FILE}"
    encode, entries = byte_vocabulary(path)
    library = library_encoder(path)
    assert encode is not library and len(entries) == 50257
    texts = [t for _, t in CASES if t] + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()]
    texts += ["".join(f" a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)} \n{chr(c)} \n" for c in range(a, a + 64) if not 0xD800 <= c <= 0xDFFF) for a in range(0, 0x110000, 64 * 11)]
    assert encode(texts) == library(texts)


def tokens(texts):
    """(ids, byte ends) of both tokenizers for each text, by the libraries' own per-token bytes."""
    bytes_a, enc_a = byte_vocabulary(f"{alignment.FOLDER}/{alignment.BYTE_FILE}")[1], library_encoder(f"{alignment.FOLDER}/{alignment.BYTE_FILE}")
    enc_b, bytes_b = piece_vocabulary(f"{alignment.FOLDER}/{alignment.PIECE_FILE}")
    out = []
    for t in texts:
        sides = []
        for enc, entries in ((enc_a, bytes_a), (enc_b, bytes_b)):
            ids = enc([t])[0] if t else []
            at, ends = 0, []
            for i in ids:
                at += len(entries[i])
                ends.append(at)
            whole = b"".join(entries[i] for i in ids) == (" " + (t or "")).encode()
            sides.append((ids, ends) if t and whole else None)
        out.append(sides if all(sides) else [([], []), ([], [])])
    return out


def brute(rows):
    found = tokens([t for _, t in rows])
    links = [[(a, b) for a, e in zip(*x) for b, f in zip(*y) if e == f] for x, y in found]
    count = Counter(p for each in links for p in each)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), ((a, ea), (b, eb)), mine in zip(rows, found, links):
        both = sorted(set(ea) & set(eb))
        groups, start = [], 0
        for end in both:
            groups.append(",".join(str(x) for x, e in zip(a, ea) if start < e <= end) + "|" + ",".join(str(x) for x, e in zip(b, eb) if start < e <= end))
            start = end
        out.append((i, len(a), len(b), len(groups), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), ";".join(groups)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


CASES = [(1, "the cat sat"), (1, "the cat sat"), (2, "the cat  sat\n\ton a mat"), (None, "the cat sat"), (None, None), (3, ""), (4, None), (5, "<|endoftext|> <s></s><0x41> <unk>"),
         (6, "naïve 😀 漢字 \u0000  "), (7, "a▁b"), (8, " "), (9, "unbelievably " * 3000), (10, "ab" * 20000), (-3, "The Cat sat")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in CASES], "doc_id long, text string, key string, copies int")
    got = [tuple(r) for r in align(spark, docs).collect()]
    assert sorted(got, key=key) == sorted(brute(CASES), key=key)
    by = {r[0]: r for r in got}
    assert by[7][1:] == (0, 0, 0, 0, 0, 0, "")  # the piece model gives U+2581 back as a space
    assert by[5][1] > 5 and by[9][4] > 3000
    assert align(spark, docs.limit(0)).count() == 0
    assert align(spark, docs.filter("text is null")).count() == 2


def test_each_distinct_text_once(spark):
    docs = spark.createDataFrame([(i, "a hot text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    texts = aligned_texts(spark, docs)
    assert texts.count() == 1001 and texts.agg(F.sum("copies")).first()[0] == 3000
    pairs = pair_counts(spark, texts)
    assert pairs.agg(F.sum("count")).first()[0] == texts.agg(F.sum(F.col("copies") * F.size("links"))).first()[0]
    got = align(spark, docs)  # one text is hot, the others are not
    assert got.count() == 3000 and got.filter("doc_id % 3 <> 0").select("n_a", "count_sum", "groups").distinct().count() == 1


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    df = op11_alignment(spark, SF)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
