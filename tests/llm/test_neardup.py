import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daqframe.llm import neardup
from daqframe.llm.neardup import Settings, common, near_duplicates, shingle_sets
from daqframe.llm.textblock import TextBlock
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((root(i), root(j)))
                up[v] = u
    return {(i, len(shingles(t, k)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows}


def edited(words, share, rng):
    return " ".join(f"z{rng.random()}" if rng.random() < share else w for w in words)


def near_group(n, seed, share=0.04, length=120):
    rng = random.Random(seed)
    base = prose(seed, length, 100000).split()
    return [edited(base, share * rng.random(), rng) for _ in range(n)]


@pytest.mark.parametrize("settings", [Settings(3, 85), Settings()])
def test_components_match_brute_force(spark, documents, odd_rows, settings):
    rows = list(odd_rows)
    for g in range(3):
        rows += [(1000 * (g + 1) + i, t) for i, t in enumerate(near_group(90, g))]
    rows += [(9000, rows[30][1].upper()), (9001, rows[31][1]), (None, rows[31][1]), (9002, "two words"), (9003, "Two  words"), (9004, "two")]
    random.Random(1).shuffle(rows)
    got = {tuple(r) for r in near_duplicates(documents(rows).withColumn("component_id", F.lit(1)), settings).collect()}
    assert got == brute(rows, settings.shingle, settings.percent)


def test_repeated_rows_and_empty_table(spark, documents):
    assert near_duplicates(documents([])).collect() == []
    got = near_duplicates(documents([(5, "same text of one row here"), (5, "same text of one row here"), (6, "other words that differ"), (6, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True)]


def thue_morse(letters, signs):
    return "".join(signs[bin(i).count("1") & 1] for i in range(letters))


def test_texts_made_to_collide_and_equal_sets_of_other_words(spark, documents):
    rest = prose(3, 30, 4000).split()
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        rows += [(10 * k + 1, " ".join(rest[:2] + [thue_morse(n, "ab")])), (10 * k + 2, " ".join(rest[:2] + [thue_morse(n, "ba")])), (10 * k + 3, " ".join(thue_morse(n, "xy"))), (10 * k + 4, " ".join(thue_morse(n, "yx")))]
    rows += [(100 + k, " ".join("one two three four five six".split() * (2 + k))) for k in range(6)] + [(110, rows[-1][1])]
    for settings in (Settings(3, 85), Settings()):
        got = {tuple(r) for r in near_duplicates(documents(rows), settings).collect()}
        assert got == brute(rows, settings.shingle, settings.percent)


def test_words_decide_where_hashes_are_equal(monkeypatch):
    texts = ["a b c d e a b c", "a b c d x y z", "a b", "b a", "", "a  b"]
    sound = TextBlock.hashes
    for bits in (0, 1, 3):
        monkeypatch.setattr(TextBlock, "hashes", lambda self, s, e, salt=0, bits=bits: sound(self, s, e, salt) & np.uint64((1 << bits) - 1))
        sets = shingle_sets(TextBlock.of(texts), 3)
        want = [shingles(t, 3) for t in texts]
        assert np.diff(sets.bounds).tolist() == [len(w) for w in want]
        assert common(sets).tolist() == [len(want[i] & want[i + 1]) for i in (0, 2, 4)]


def test_many_single_documents_that_share_rare_shingles(spark, documents, monkeypatch):
    """A family just below the threshold, with some pairs above it, none of them the first of its buckets."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    rng = random.Random(7)
    base = prose(40, 60, 100000).split()
    rows = [(i, edited(base, 0.07, rng)) for i in range(150)]
    rows += [(1000 + i, edited(rows[3 * i][1].split(), 0.01, rng)) for i in range(30)]
    rows += [(5, rows[170][1]), (5, prose(77, 50, 5000)), (2000, prose(77, 50, 5000) + " end")]
    got = {tuple(r) for r in near_duplicates(documents(rows), Settings(3, 85)).collect()}
    assert {(i, c) for i, _, c, _ in got} == {(i, c) for i, _, c, _ in brute(rows, 3, 85)}
