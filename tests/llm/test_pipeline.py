"""The pipeline's rows stage by stage against plain versions, and the named queries' columns."""

import brute
import pytest
from test_operators import plain_mix

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, folder):
    from replenish.llm.tables import read

    docs = read(spark, folder, "documents")
    columns = docs.columns
    text = {r["doc_id"]: r for r in docs.collect()}
    done = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        done.append((name, docs.collect()))
        docs = spark.createDataFrame(done[-1][1], docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good, single, clean, mixed, sharded = (r for _, r in done)
    # too few labels here to certify a cutoff, also in the pooled stratum
    assert {r["doc_id"] for r in good} == {i for i, r in text.items() if not brute.quality_counts(r["text"])[-1]}
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in good}
    root = brute.linked(set(prints.values()))
    low = {}
    for i, p in prints.items():
        low[root[p]] = min(low.get(root[p], i), i)
    assert sorted(r["doc_id"] for r in single) == sorted(low.values())
    items = [" ".join(r["text"].split()) for r in read(spark, folder, "benchmark").collect()]
    held = {r["doc_id"] for r in single if any(x in " ".join(r["text"].split()) for x in items)}
    assert {r["doc_id"] for r in single} - {r["doc_id"] for r in clean} == held
    want = {c[0]: (c[4] // c[1] if c[1] else 0) for c in plain_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in clean])}
    got = {}
    for r in mixed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    assert len(sharded) == len(mixed)


def test_named_queries(spark, folder):
    from replenish.llm.queries import ORACLE_SQL, QUERIES

    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_named_queries_match_sql(spark, folder):
    from harness import connect, rows_of

    from replenish.llm.queries import ORACLE_SQL, QUERIES

    con = connect(folder)
    for key, sql in ORACLE_SQL.items():
        df = QUERIES[key](spark, folder)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want.fetchall()), key
