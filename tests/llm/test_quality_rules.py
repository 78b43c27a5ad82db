import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from daqframe.llm.quality_rules import STATISTICS, average_path, features, fit, judge, quality_rules, rule_statistics, statistics_of
from daqframe.llm.textblock import TextBlock

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark, documents, odd_rows):
    rows = odd_rows + [(500, "one two three four five six seven eight nine " * 3 + "tail"), (500, "same id"), (None, "no id")]
    got = {(r[0], tuple(r[1:6])) for r in rule_statistics(documents(rows)).collect()}
    assert got == {(i, brute(t)) for i, t in rows}


def test_statistics_where_hashes_are_equal(monkeypatch):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [f"{a}\n{b}\n{a}\nx", "p q r s t u v w x p q r s t u v w y\np q\np q", " ".join(a), None]

    def statistics():
        got = statistics_of(pa.array(texts, pa.string()))
        return list(zip(*(got[k].tolist() for k in STATISTICS[:5]))), got["n_distinct_words"].tolist()

    want = [brute(t) for t in texts], [len(set(WORD.findall(t or ""))) for t in texts]
    assert statistics() == want
    sound = TextBlock.hashes
    for bits in (0, 2):
        monkeypatch.setattr(TextBlock, "hashes", lambda self, s, e, salt=0, bits=bits: sound(self, s, e, salt) & np.uint64((1 << bits) - 1))
        assert statistics() == want


def test_forest_rejects_junk_and_keeps_prose(spark, documents):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 80 + i % 50)) for i in range(300)] + [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows[::2]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules(documents(rows), labels).collect()}
    assert sum(got[i] for i in range(300)) >= 295
    assert sum(got[1000 + i] for i in range(40)) <= 5


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(documents([]), labels).collect() == []
    kept = [r.kept for r in quality_rules(documents([(1, "word " + " ".join(f"w{i}" for i in range(30))), (2, None)]), labels).orderBy("doc_id").collect()]
    assert kept == [True, False]


def test_kept_equals_a_plain_walk_of_the_trees(spark, documents):
    """judge against paths walked one row and one tree at a time, and the threshold against all that could be chosen."""
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 40 + i % 70)) for i in range(150)] + [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 40 + i).split())) for i in range(30)] + [(2000, None), (2001, "too few words")]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    forest = fit(documents(rows), labels, trees=20, subsample=64, depth=6)
    got = {r.doc_id: r for r in judge(documents(rows), forest).collect()}
    scores = {}
    for i, t in rows:
        s = statistics_of(pa.array([t], pa.string()))
        x, total = features(s)[0], 0.0
        for tree in range(len(forest.feature)):
            node = 0
            for _ in range(forest.depth):
                if forest.child[tree, node] == node:
                    break
                node = forest.child[tree, node] + int(x[forest.feature[tree, node]] >= forest.split[tree, node])
            total += forest.length[tree, node]
        scores[i] = 2 ** (-(total / len(forest.feature)) / float(average_path(forest.sample)))
        n_words, _, _, _, repeats = brute(t)
        failed = n_words < 20 or 100 * repeats > 30 * n_words
        assert abs(got[i].anomaly - scores[i]) < 1e-12
        assert (got[i].base_failed, got[i].kept) == (failed, not failed and got[i].anomaly <= forest.threshold)
    good, bad = [v for i, v in scores.items() if i < 1000], [v for i, v in scores.items() if 1000 <= i < 2000]
    assert sum(v <= forest.threshold + 1e-12 for v in good) >= 0.998 * len(good) - 1
    assert sum(v > forest.threshold for v in bad) >= 0.8 * len(bad)


def test_every_labelled_row_counts(spark, documents):
    """A kind of good documents whose ids hash behind those of 8,192 others is kept too."""
    from pyspark.sql import functions as F
    from tests.llm.conftest import prose

    ids = [r.id for r in spark.range(10_000).orderBy(F.xxhash64("id")).collect()]
    seen, late = ids[:9_000], ids[9_000:]
    kinds = [prose(k, 30 + k) for k in range(50)]
    late_kinds = [" ".join(w.upper() + "!!" for w in prose(k, 30 + k).split()) for k in range(50)]
    rows = [(i, kinds[i % 50]) for i in seen] + [(i, late_kinds[i % 50]) for i in late] + [(20_000 + i, " ".join(f"{w}###$$$" for w in kinds[i % 50].split())) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 20_000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules(documents(rows), labels).collect()}
    assert sum(got[i] for i in seen + late) >= 0.998 * 10_000 - 1
    assert sum(got[i] for i in late) >= 980
    assert sum(got[20_000 + i] for i in range(100)) <= 10


def test_forest_is_that_of_all_rows(spark, documents):
    """Mean path lengths from counts of all rows at each node, one row and one tree at a time, and the threshold from all scores; rows of one doc_id count one by one."""
    from pyspark.sql import functions as F
    from tests.llm.conftest import prose

    rows = [(i // 2, prose(i, 30 + i % 70)) for i in range(120)] + [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 40 + i).split())) for i in range(30)] + [(2000, "too few words")]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i in {i for i, _ in rows}], "doc_id long, quality int, toxic int")
    forest = fit(documents(rows), labels, trees=6, subsample=20, depth=5, keep_share=0.9)
    assert forest.sample == 20
    half = {r.id: r.h for r in spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    x = {k: features(statistics_of(pa.array([t], pa.string())))[0] for k, (_, t) in enumerate(rows[:-1])}
    good = [k for k in x if rows[k][0] < 1000]
    paths = {}
    for tree in range(6):
        grown = [k for k in good if half[rows[k][0]] == tree // 3]
        met = {}
        for k in x:
            met[k] = [0]
            while forest.child[tree, met[k][-1]] != met[k][-1]:
                node = met[k][-1]
                met[k].append(forest.child[tree, node] + int(x[k][forest.feature[tree, node]] >= forest.split[tree, node]))
        share = {v: sum(v in met[g] for g in grown) / len(grown) for nodes in met.values() for v in nodes}
        for k, nodes in met.items():
            assert len(nodes) == 6 or share[nodes[-1]] == 0
            paths[tree, k] = sum(sum(math.comb(20, n) * share[v] ** n * (1 - share[v]) ** (20 - n) for n in range(2, 21)) for v in nodes[:-1])
            paths[tree, k] += float(average_path(20 * share[nodes[-1]]))
            assert abs(forest.length[tree, nodes[-1]] - paths[tree, k]) < 1e-9

    def score(k):
        judges = [t for t in range(6) if k not in good or t // 3 != half[rows[k][0]]]
        return 2 ** (-np.mean([paths[t, k] for t in judges]) / float(average_path(20)))

    scores = {k: score(k) for k in x}
    bad = [k for k in x if k not in good]

    def errors(cut):
        return sum(scores[k] > cut for k in good) / len(good) + sum(scores[k] <= cut for k in bad) / len(bad)

    able = [scores[k] for k in x if sum(scores[g] <= scores[k] for g in good) >= 0.9 * len(good)]
    assert sum(scores[g] <= forest.threshold for g in good) >= 0.9 * len(good)
    assert errors(forest.threshold) <= min(map(errors, able)) + 1e-9
