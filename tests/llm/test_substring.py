import hashlib
import random
import re

import numpy as np
import pytest

from daqframe.llm.substring import anchors, repeated_passages, without_repeats
from daqframe.llm.textblock import TextBlock
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=50):
    least = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - size + 1) if i is not None else ():
            w = tuple(words[k : k + size])
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - size + 1) if i is not None else ():
            if least[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return sorted(out, key=str)


def test_anchor_depends_on_the_window_alone():
    rng = random.Random(2)
    for vocabulary in (1, 2, 3, 50, 5000):
        core = [f"c{rng.randrange(vocabulary)}" for _ in range(90)]
        seen = []
        for k in range(30):
            before = [f"c{rng.randrange(vocabulary)}" for _ in range(rng.randrange(80))]
            after = [f"c{rng.randrange(vocabulary)}" for _ in range(rng.randrange(80))]
            block = TextBlock.of([" ".join(before + core + after)])
            s, e, b = block.words()
            start, anchor = anchors(block.hashes(s, e), b)
            here = np.searchsorted(start, len(before))
            seen.append(tuple(anchor[here : here + 41]))
        assert len(set(seen)) == 1


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, documents, odd_rows, seed):
    rng = random.Random(seed)
    rows = list(odd_rows)
    passages = [prose(100 + i, rng.choice([30, 49, 50, 51, 70, 120]), 4000) for i in range(12)]
    for i in range(60):
        parts = [prose(1000 * seed + i, rng.randrange(0, 90), 3000)] + [x for _ in range(rng.randrange(3)) for x in (rng.choice(passages), prose(rng.random(), rng.randrange(20), 3000))]
        rows.append((200 + i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(300, rows[60][1]), (301, rows[60][1].replace(" ", "\n")), (302, "a " * 500), (303, "b " + "a " * 120), (None, rows[60][1]), (240, rows[61][1] + " " + passages[5]), (400, rows[70][1]), (400, rows[70][1])]
    rng.shuffle(rows)
    got = repeated_passages(documents(rows), with_text=True).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_texts_without_repeats(spark, documents):
    passage = prose(9, 60, 4000)
    rows = [(1, "a  b " + passage), (2, passage + "\n tail"), (3, passage), (3, "x " + passage + " y"), (3, "plain\ttext"), (4, None), (5, passage)]
    got = sorted(((r.doc_id, r.text, r.source) for r in without_repeats(documents(rows)).collect()), key=str)
    assert got == sorted([(1, "a  b " + passage, "src0"), (2, "tail", "src0"), (3, "", "src0"), (3, "x y", "src0"), (3, "plain\ttext", "src0"), (4, None, "src0"), (5, "", "src0")], key=str)


def test_empty_table(spark, documents):
    assert repeated_passages(documents([])).collect() == []


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_texts_made_to_collide(spark, documents, letters):
    """Thue-Morse sequences and their complements have equal sums of powers for any base."""
    bits = [bin(i).count("1") & 1 for i in range(letters)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = prose(3, 30, 4000).split()
    rows = [(1, " ".join(rest + [one] + rest[::-1])), (2, " ".join(rest + [other] + rest[::-1])), (3, " ".join("xy"[b] for b in bits)), (4, " ".join("yx"[b] for b in bits))]
    got = repeated_passages(documents(rows), with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str) == brute(rows)
    assert {r.doc_id: r.n_removed for r in got}[2] == 0
