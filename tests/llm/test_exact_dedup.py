import hashlib
from collections import defaultdict

import pytest

from factloom.llm import exact_dedup

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        stays = [False] * len(ids)
        stays[ids.index(top)] = True
        out += [(i, top, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, stays, strict=True)]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


ODD = [
    (1, None), (2, ""), (None, ""), (3, "Ab é"), (4, "aB é"), (5, "ab É"), (6, " ab é"), (7, "x" * 9000), (7, "X" * 9000), (8, "x" * 8999 + "y"),
    (None, "only null"), (None, "ONLY null"), (9, "\n"), (10, "word and " * 20000), (11, "word and " * 20000), (12, "word and " * 19999 + "word end "),
]


@pytest.mark.parametrize("bits", [64, 4])
def test_odd_rows_even_when_identifiers_clash(spark, bits):
    df = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, ids int").repartition(3)
    assert found(exact_dedup.dedup(df, id_bits=bits)) == brute(ODD)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(exact_dedup.query(spark, SF)) == brute(rows)


def test_no_python_runs(spark):
    plan = exact_dedup.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_that_stay(spark):
    rows = [(1, "a", "p"), (2, "A", "q"), (2, "A", "q"), (2, "b", "r"), (None, "c", "s"), (None, "C", "t"), (3, None, "u"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted((repr(r["doc_id"]), (r["text"] or "").lower()) for r in exact_dedup.deduplicated(df).collect())
    assert got == [("2", "a"), ("2", "b"), ("4", ""), ("None", "c")]
    assert exact_dedup.deduplicated(df.limit(0)).count() == 0
    assert exact_dedup.deduplicated(df).columns == df.columns
