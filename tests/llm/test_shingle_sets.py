"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import shingle_sets, simhash


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [shingles(t) for _, t in rows]
    parent = np.arange(len(rows))
    for i, x in enumerate(sets):
        j = [j for j, y in enumerate(sets[:i]) if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0]
        simhash._unite(parent, np.full(len(j), i), np.array(j, dtype=np.int64))
    return {rows[i][0]: rows[r][0] for i, r in enumerate(simhash._find(parent, np.arange(len(rows))))}


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def corpus(rng: random.Random) -> list[tuple[int, str]]:
    texts = ["", " \n", "one", "ONE ", "one two", "a b c d e"]
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 300))]
        texts += [" ".join(words), " ".join(words).upper()]
        for k in range(3):
            texts.append(" ".join(edited(rng, words, max(1, len(words) * k // 50))))
            texts.append(" ".join(edited(rng, words, min(len(words), len(words) // 12 + 1))))
    # A chain whose ends are far apart, and one large group around a centre.
    words = [f"c{i}" for i in range(200)]
    for _ in range(12):
        words = edited(rng, words, 3)
        texts.append(" ".join(words))
    texts += [" ".join(edited(rng, [f"h{i}" for i in range(150)], 3)) for _ in range(120)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block, items", [(2048, 1 << 20), (16, 1 << 20), (2048, 3000)])
def test_components_are_those_of_all_pairs(spark, block, items):
    rows = corpus(random.Random(11))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: r.component_id for r in shingle_sets.similar_components(df, block=block, block_items=items).collect()}
    assert got == brute_components(rows)


def test_links_of_a_group_grow_with_the_group():
    """Pairs at about half, and pairs around 80 %: what leaves a task is a forest, whatever the number of pairs."""
    rng = random.Random(13)
    for changes, linked in ((5, False), (2, True)):
        base = [f"w{i}" for i in range(150)]
        sets = [shingle_sets.shingle_set(" ".join(edited(rng, base, changes))) for _ in range(400)]
        node = np.arange(400)
        a, b = shingle_sets.spanning_links(node, node, sets)
        assert len(a) < 400 and len(a) == len(set(zip(a, b)))
        assert (len(a) > 300) == linked
        half = np.arange(400) % 2 == 1
        a, b = shingle_sets.spanning_links(node, node, sets, half)
        assert len(a) < 400 and all(half[i] != half[j] for i, j in zip(a, b))


def test_stage_drops_edited_copies(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(edited(rng, words, 6 if i else 0))) for i in range(30)] + [(100, "nothing of the kind is said in this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {0, 100}
    assert simhash.keep_one(df).count() > 2
