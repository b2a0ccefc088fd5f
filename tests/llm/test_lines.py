import hashlib

import duckdb

from weft.llm.lines import OP9_SQL, dedup_lines, op9_lines

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Rows by id (null last); equal rows one after the other."""
    seen, kept = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        l = (t or "").split("\n")
        gone = set()
        for at in range(len(l) - 2):
            w = tuple(l[at : at + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {at, at + 1, at + 2}
                seen.add(w)
        kept.append((i, len(l), len(gone), "\n".join(x for n, x in enumerate(l) if n not in gone)))
    return kept


def same(got, want):
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:3]), r[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "a\nb"), (8, "a\nb\nc"), (9, "é\n" * 5000), (10, "c\nd\n"), (20, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, at int, gone string")
    same([tuple(r) for r in dedup_lines(spark, df).collect()], brute(rows))
    assert dedup_lines(spark, df.limit(0)).count() == 0


def test_null_ids_and_equal_rows(spark):
    rows = [(None, "k\nl\nm\nn")] * 3 + [(1, "r\ns\nt")] * 4 + [(2, "r\ns\nt\nu")] + [(None, None)] * 2 + [(None, "z\nr\ns\nt"), (3, ""), (3, ""), (4, "one\ntwo\nthree\none\ntwo\nthree")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = [tuple(r) for r in dedup_lines(spark, df).collect()]
    same(got, brute(rows))
    assert sorted(g[2] for g in got if g[0] is None and g[1] == 4 and "k" in (g[3] + "k")) and [g[3] for g in got].count("k\nl\nm\nn") == 1


def test_query_and_sql(spark):
    out = {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in op9_lines(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert out == set(con.execute(OP9_SQL).fetchall())
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert out == {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows)}
    assert sum(g for _, _, g, _ in out) > 0
