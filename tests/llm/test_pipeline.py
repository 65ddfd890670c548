"""The pipeline's stages, each on the output of the one before."""

import hashlib

import corpus_pipeline
from cindersift.llm import decontaminate, near, queries, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = [first]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in seen[1] for i in good) / len(good) > 0.95
    blank = {i for i, r in seen[1].items() if not (r.text or "").strip()}
    assert {i for i, r in seen[2].items() if not (r.text or "").strip()} == blank  # no document is emptied and kept
    first_lines: dict = {}
    for i in sorted(seen[1]):
        for x in (seen[1][i].text or "").split("\n"):
            first_lines.setdefault(x, i)
    alone = {i for x, i in first_lines.items() if x.strip() and sum(x in (r.text or "").split("\n") for r in seen[1].values()) == 1}
    kept_lines = {x for r in seen[2].values() for x in (r.text or "").split("\n")}
    assert all(i in seen[2] for i in seen[1] if any(x.strip() and x in kept_lines for x in (seen[1][i].text or "").split("\n") if first_lines[x] == i)) and alone
    assert all(set(seen[2][i].text.split("\n")) <= set(seen[1][i].text.split("\n")) | {""} for i in seen[2])
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert near.near_duplicates(docs, 80).where("not kept").count() == 0
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(last) == set(seen[-1])
    assert all(last[i].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in seen[-1].items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(last)


def test_registered_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(queries.QUERIES) <= set(names) and quality.THRESHOLD == 0.3
