import random

import corpus_pipeline
from daqframe.llm import packing, quality_classifier
from tests.llm import test_neardup, test_packing, test_secrets, test_substring
from tests.llm.conftest import prose


def corpus():
    rng = random.Random(8)
    passages = [prose(100 + i, 70, 4000) for i in range(6)]
    rows = [(i, " ".join([prose(i, 60 + i % 40, 3000), *rng.choices(passages, k=i % 2), prose(1000 + i, 20, 3000)])) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(15)] + [(300 + i, rows[40 + i][1] + " tail") for i in range(15)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(60)]
    rows += [(500 + i, prose(2000 + i, 50, 3000) + " " + test_secrets.samples(i)) for i in range(20)]
    return rows + [(600, None), (601, ""), (602, "a b c")]


def test_stages_match_brute_force(spark, documents, tmp_path):
    rows = corpus()
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 400 <= i < 460), 0) for i, _ in rows if i < 600], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]

    model = quality_classifier.fit(documents(rows), spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = {r.doc_id: r.score for r in quality_classifier.scores(documents(rows), model).collect()}
    assert texts[0] == {i: t for i, t in rows if scores[i] >= 0.3}
    assert sum(400 <= i < 460 for i in texts[0]) <= 6 and sum(i < 400 for i in texts[0]) >= 148
    kept = {i for i, _, _, keep in test_neardup.brute(list(texts[0].items()), 5, 80) if keep}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in kept}
    cut = {r[0]: r[4] for r in test_substring.brute(list(texts[1].items()))}
    assert texts[2] == {i: t if cut[i] is None else cut[i] for i, t in texts[1].items()}
    assert sum(v is not None for v in cut.values()) > 20
    for i, t in texts[2].items():
        spans, at, want = test_secrets.brute(t), 0, ""
        for a, z in (map(int, s.split(":")[1:]) for s in spans):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, z)
        assert texts[3][i] == (want + t[at:] if spans else t)
    assert all(r.n_chars == len(r.text or "") for r in seen[3].collect())
    pieces = seen[4].collect()
    assert {r.doc_id for r in pieces} == set(texts[3])
    encode = packing.tokenizer(corpus_pipeline.VOCABULARY)
    lengths = {i: len(encode.encode_ordinary(t or "")) + 1 for i, t in texts[3].items()}
    assert {r.doc_id: r.length for r in pieces} == lengths
    assert len({r.sequence_id for r in pieces}) == test_packing.best_fit_decreasing(list(lengths.values()), 2048)
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r)[:5] for r in pieces)
