import math
import random
from collections import Counter

import numpy as np
import pytest

from trapline.llm import kneser_ney

SCHEMA = "doc_id long, text string, n_tokens int, score string, _key int, _text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, "x") for i, t in rows], SCHEMA)


def spoken(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            said = spoken(text)
            self.words.update(said)
            self.pairs.update(zip(["<s>", *said], said))
        self.before = Counter(w for _, w in self.pairs)
        self.total, self.kinds = sum(self.words.values()), len(self.words)
        self.d2, self.d1 = (self.discounts(c) for c in (self.pairs, self.before))
        self.whole, self.rest = Counter(), Counter()
        for (v, _), n in self.pairs.items():
            self.whole[v] += n
            self.rest[v] += self.d2[min(n, 3) - 1]

    @staticmethod
    def discounts(counts):
        return kneser_ney.discounts([sum(n == k for n in counts.values()) for k in range(1, 5)])

    def single(self, w):
        every = len(self.pairs)
        if not every:
            return 1.0
        left = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / every
        n = self.before[w]
        return (n - (self.d1[min(n, 3) - 1] if n else 0)) / every + left / (self.kinds + 1)

    def pair(self, v, w):
        if v not in self.whole:
            return self.single(w)
        n = self.pairs[v, w]
        return ((n - (self.d2[min(n, 3) - 1] if n else 0)) + self.rest[v] * self.single(w)
                ) / self.whole[v]

    def row(self, text):
        said = spoken(text)
        base = sum(math.log10((self.words[w] + 0.5) / (self.total + 0.5 * (self.kinds + 1)))
                   for w in said)
        score = sum(math.log10(self.pair(v, w)) for v, w in zip(["<s>", *said], said))
        return len(said), sum(w in self.words for w in said), self.total, base, score


def texts(n, seed=1):
    pick = random.Random(seed)
    words = [f"w{int(60 * pick.random() ** 3)}" for _ in range(400)] + ["Über", "ÉCOLE", "A b"]
    return [" ".join(pick.choices(words, k=pick.randint(0, 60))) for _ in range(n)]


ODD = [None, "", " \n\t", "unseen words only", "w1 " * 5000, "W1 w1\x0bW2", "x\0y"]


def compared(spark, learnt, scored):
    model = kneser_ney.train(table(spark, list(enumerate(learnt))).repartition(3))
    got = kneser_ney.score(table(spark, list(enumerate(scored))).repartition(2), model).collect()
    brute = Brute(learnt)
    assert len(got) == len(scored)
    for r in got:
        want = brute.row(scored[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-want[4] / want[0]))
    return model


def test_equals_dictionaries(spark):
    learnt = texts(80) + ODD[:3]
    compared(spark, learnt, learnt + texts(30, 2) + ODD)


@pytest.mark.parametrize("shard,hot", [(200, 1000), (200, 8), (50, 2)])
def test_small_parts_give_the_same(spark, monkeypatch, shard, hot):
    """Many shards, spread words, chunks and slices that texts cross, shards closed again."""
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", shard)
    monkeypatch.setattr(kneser_ney, "HOT", hot)
    model = compared(spark, texts(60), texts(20, 2) + ODD)
    assert model.shards > 10


def test_parts_of_long_texts(monkeypatch):
    want = [list(zip(["<s>", *spoken(t)], spoken(t))) for t in texts(20) + ODD]
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 16)
    parts = list(kneser_ney.tokens(texts(20) + ODD))
    owner, before, token = map(np.concatenate, zip(*parts))
    assert len(parts) > 100 and np.bincount(owner).tolist() == [len(w) for w in want]
    code = {w: kneser_ney.xxhash.xxh3_64_intdigest(w.encode()) for p in want for x in p for w in x}
    code |= {"<s>": int(kneser_ney._BEGIN), "</s>": kneser_ney._END}
    assert list(zip(before.tolist(), token.tolist())) == [
        (code[v], code[w]) for p in want for v, w in p]


def test_texts_across_chunks(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 64)
    batches = [pa.record_batch({"t": pa.array(t, pa.string())}) for t in (
        texts(9), [], ODD, texts(3, 4))]
    got = np.concatenate([c[0] for c in kneser_ney._chunks(batches, 0, 7)])
    assert np.bincount(got).tolist() == [len(spoken(t)) for t in texts(9) + ODD + texts(3, 4)]


def test_probabilities_sum_to_one(spark):
    brute = Brute(texts(80))
    for v in ("<s>", "w1", "never"):
        assert sum(brute.pair(v, w) for w in [*brute.words, "unseen"]) == pytest.approx(1)


def test_nothing_learnt_and_no_rows(spark):
    model = compared(spark, [], ["a b", ""])
    assert kneser_ney.score(table(spark, []), model).collect() == []


def test_files_keep_large_counts(tmp_path):
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 63, 1000).astype(np.uint64) * 2)
    planes = [np.arange(1000), np.full(1000, 255), np.arange(1000) * 10 ** 12]
    kneser_ney.write_file(str(tmp_path), "words-3", kneser_ney._filed(keys, planes))
    held = kneser_ney.Mapped(str(tmp_path), "words-3")
    asked = np.sort(np.concatenate([keys, keys + np.uint64(1)]))
    got = held.find(asked)
    assert (got[:, asked % 2 == 1] == 0).all()
    assert got[:, asked % 2 == 0].tolist() == [p.tolist() for p in planes]


def test_better_than_words_alone_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = kneser_ney.held_out(docs.doc_id)
    rows = kneser_ney.score(docs, kneser_ney.train(docs.where(~out))).join(
        docs.select("doc_id", out.alias("out")), "doc_id").where("out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    import pyarrow as pa
    model = kneser_ney.train(table(spark, list(enumerate(texts(40)))))
    asked = texts(20, 2) + ODD
    whole = [pa.record_batch({"t": pa.array(asked, pa.string()),
                              "k": pa.array(range(len(asked)))})]
    want = [tuple(r.values()) for b in kneser_ney._scored(model)(whole) for r in b.to_pylist()]
    assert [r[0] for r in want] == list(range(len(asked)))
    for chunk in (1, 7, 100):
        monkeypatch.setattr(kneser_ney, "SCORE_TOKENS", chunk)
        monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 64)
        parts = [whole[0].slice(0, 5), whole[0].slice(5, 0), whole[0].slice(5)]
        got = [tuple(r.values()) for b in kneser_ney._scored(model)(parts) for r in b.to_pylist()]
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[3:] for r in got] == [pytest.approx(r[3:]) for r in want]
