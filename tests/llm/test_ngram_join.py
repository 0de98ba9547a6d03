import random

import pytest

from tests.llm import brute
from trapline.llm import ngram_join

SCHEMA = "doc_id long, text string, ids string, n_shingles int, fragment int, root long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def corpus(seed=4, families=25):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=4)) for _ in range(400)]
    common = rng.choices(words, k=30)
    rows = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(3, 120))
        if rng.random() < 0.5:
            base[3:3] = common
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = [w.upper() for w in text]
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize("words,similarity", [(3, (90, 100)), (5, (80, 100))])
def test_against_all_pairs(spark, monkeypatch, words, similarity):
    for name in ("BLOCK_SHINGLES", "FRAGMENT_SHINGLES"):
        monkeypatch.setattr(ngram_join, name, 300)
    rows = corpus()
    sets, roots = brute.jaccard_links(dict(rows), words, similarity)
    assert len(set(roots.values())) < len(rows) - 10
    got = ngram_join.join(table(spark, rows), words=words, similarity=similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {
        i: (len(sets[i]), roots[i]) for i, _ in rows}


def test_a_large_group_of_near_copies(spark):
    """Copies that each differ from the first one in another place, and stragglers that only
    link with some of them."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    _, roots = brute.jaccard_links(dict(rows), 3, (90, 100))
    got = {r.doc_id: r.component_id for r in ngram_join.join(
        table(spark, rows), words=3, similarity=(90, 100)).collect()}
    assert got == roots


def test_odd_texts(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (3, "ONE  two"), (9, "two one"),
            (10, "É b"), (11, "é b"), (12, "a b c"), (13, "a b c"), (None, "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(
        table(spark, rows), words=3, similarity=(90, 100)).collect()}
    assert got == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 3), 3: (1, 3), 9: (1, 9),
                   10: (1, 10), 11: (1, 11), 12: (1, 12), 13: (1, 13), None: (1, 3)}


def test_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(4, long)] * 3 + [(2, long + " end"), (1, "short one")]
    got = sorted(map(tuple, ngram_join.join(table(spark, rows)).collect()))
    assert got == [(1, 1, 1), (2, 59_997, 2)] + [(4, 59_996, 2)] * 3


def test_no_rows(spark):
    got = ngram_join.join(table(spark, []))
    assert got.collect() == [] and got.columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("rows_of_a_block,segment", [(512, 1 << 16), (4, 8)])
def test_a_passage_that_most_documents_hold(spark, monkeypatch, rows_of_a_block, segment):
    """Its shingles are among the rarest of short documents, so their list is long; it is cut
    into blocks, and no link is lost or added."""
    monkeypatch.setattr(ngram_join, "LIST_ROWS", rows_of_a_block)
    monkeypatch.setattr(ngram_join, "SEGMENT_SHINGLES", segment)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(260):
        own = [f"q{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))]
        rows.append((i, " ".join(passage[:rng.choice([12, 20, 24])] + own)))
    sets, roots = brute.jaccard_links(dict(rows), 3, (90, 100))
    assert 20 < len(set(roots.values())) < 200
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(
        table(spark, rows), words=3, similarity=(90, 100)).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i, _ in rows}


@pytest.mark.parametrize("bits", [64, 128, 1 << 26])
def test_texts_are_chosen_at_any_size_of_the_map(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "MAP_BITS", bits)
    named = table(spark, [(i, f"t{i % 300}") for i in range(900)]).selectExpr(
        "xxhash64(text) AS _key", "text AS _text")
    keys = named.where("_text < 't15'").select("_key").distinct()
    got = sorted(r._text for r in ngram_join.chosen_texts(named, keys).collect())
    assert got == sorted({f"t{i}" for i in range(300) if f"t{i}" < "t15"})
    assert ngram_join.chosen_texts(named, keys.limit(0)).collect() == []
