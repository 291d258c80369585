"""The pipeline, each stage on what the one before kept, against slow versions in plain Python and SQL."""

import re
from collections import Counter

import duckdb
from test_likeness import _classes, _slow_drops, _slow_simhash

import corpus_pipeline
from strandline.llm import packing, queries, toxicity
from strandline.llm.common import WORD, materialise



def test_stages_against_slow_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, rows = dict(corpus_pipeline.STAGES), docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "mixing", "packing"]

    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = materialise(stages["toxicity"](spark, docs, sf_dir), "stage-1")
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows if machine.score(r["text"] or "") < 0.5}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    drops = _slow_drops(rows)
    docs = materialise(stages["line dedup"](spark, docs, sf_dir), "stage-2")
    same = 0
    for r in docs.collect():
        before = dict(rows)[r["doc_id"]]
        want = None if before is None else "\n".join(x for p, x in enumerate(before.split("\n")) if (r["doc_id"], p) not in drops)
        same += r["text"] == want
        assert want is None or len(r["text"]) >= len(want)  # a near line may be missed, none that stands alone may go
    assert same >= 0.98 * len(rows)

    classes = _classes({r["doc_id"]: _slow_simhash(r["text"] or "") for r in docs.collect()})
    docs = materialise(stages["near-duplicates"](spark, docs, sf_dir), "stage-3")
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(classes.values()))

    docs.coalesce(1).write.parquet(f"{tmp_path}/kept")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/kept/*.parquet'")
    cursor = con.execute(queries.oracle_sql()["op9_pareto_mix"])
    at = [d[0] for d in cursor.description]
    copies = {r[at.index("doc_id")]: r[at.index("copies")] for r in cursor.fetchall()}
    docs = materialise(stages["mixing"](spark, docs, sf_dir), "stage-4")
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter({k: n for k, n in copies.items() if n})

    want = Counter()
    for r in docs.collect():
        want.update((r["doc_id"], w) for w in re.findall(WORD, r["text"] or ""))
    got, ends = Counter(), 0
    for s in stages["packing"](spark, docs, sf_dir).collect():
        bodies = packing.bodies(s["text"])
        ends += sum(1 for p in s["pieces"] if p == 0)
        assert len(bodies) == len(s["doc_ids"]) and s["used"] <= s["bin_length"]
        for k, body in zip(s["doc_ids"], bodies, strict=True):
            got.update((k, w) for w in re.findall(WORD, body))
    assert got == want and ends == docs.count()
