"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline

from queuemill.llm import toxicity
from queuemill.runtime import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    out = dict(kept)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "tokens":
            assert docs.columns == columns
        now = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.judge(before, table(spark, SF, "labels")).collect() if r["predicted"] == 1}
            assert set(now) == set(out) - bad
        elif name == "near_duplicates":
            words = {d: [w.lower() for w in t.split()] for d, t in out.items()}
            sets = {d: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
            parent = {d: d for d in sets}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        lo, hi = sorted((find(a), find(b)))
                        parent[hi] = lo
            assert set(now) == {d for d in sets if find(d) == d}
        elif name == "decontamination":
            items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
            assert set(now) == {d for d, t in out.items() if not any(i in t for i in items)}
        elif name == "personal_data":
            private = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b4\d{15}\b|AKIA[A-Z0-9]{16}")
            for d, r in now.items():
                assert not set(private.findall(out[d])) & set(private.findall(r["text"])) and len(r["text"]) == r["n_chars"]
                if not re.search(r"[0-9@]", out[d]):
                    assert r["text"] == out[d]
        else:
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and set(now) == set(out)
        if name != "tokens":
            out = {d: r["text"] for d, r in now.items()}


def test_pipeline_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "tokens":
                assert "text" in docs.columns
        assert docs.count() in (0, 10)


def test_run_is_registered(spark):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0
