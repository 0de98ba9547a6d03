import random
import re
from itertools import permutations

import pytest

from trapline.llm import filter_audit

SCHEMA = ("doc_id long, text string, source string, cell int, row long, part string, "
          "_digest string, quality int")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(spark, docs, labels):
    return (spark.createDataFrame([(i, t, s, 1, 2, "p", "d", 1) for i, t, s in docs], SCHEMA),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def fails(docs):
    for key, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        same = [k for k, t, _ in docs if (t or "") == text and k is not None]
        yield "".join(n for n, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text),
            same and (key is None or key > min(same)))) if bad)


def brute(docs, labels):
    good = {r[0] for r in labels if r[1] == 1} - {None}
    toxic = {r[0] for r in labels if r[2] == 1} - {None}
    out, failed = {}, list(fails(docs))
    for part in {s or "" for _, _, s in docs}:
        rows = [(k, f) for (k, _, s), f in zip(docs, failed) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            kept = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in kept if name in r[1]]
                kept = [r for r in kept if name not in r[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(name in f for _, f in rows) - len(gone),
                    sum(f == name for _, f in rows), sum(k in good for k, _ in gone),
                    sum(k in toxic for k, _ in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def found(frame):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in frame.collect()}


def cases():
    pick = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "x|y", "plain", "text", "日本"]
    texts = [" ".join(pick.choices(words[:k], k=n)) for k in (2, 5, 9) for n in (3, 40, 60, 90)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 51)]
    texts += ["", None, " ", "A" * 6 + "b" * 94, "A" * 5 + "b" * 95, " ", "w " * 200_000]
    docs = [(k, pick.choice(texts), pick.choice(["a", "b", None, ""])) for k in range(150)]
    docs += [(7, "same", "a")] * 3 + [(None, "same", "a"), (None, "lone", "b"), (None, "lone", "b")]
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1, None]), "t") for k in range(0, 120)]
    return docs, labels + [(7, 0, 1, "t"), (7, 1, 0, "t"), (None, 1, 1, "t")]


@pytest.mark.parametrize("heavy,bits", [(1000, 16), (30, 1)])
def test_equals_plain_python(spark, monkeypatch, heavy, bits):
    monkeypatch.setattr(filter_audit, "HEAVY", heavy)
    monkeypatch.setattr(filter_audit, "RANGE_BITS", bits)
    docs, labels = cases()
    rows, known = tables(spark, docs, labels)
    got = found(filter_audit.audit(filter_audit.failing(rows.repartition(3), known)))
    assert got == brute(docs, labels)


def test_merge_sizes_every_cell():
    pick = random.Random(3)
    for _ in range(60):
        lists = [sorted(pick.sample(range(200), pick.choice([0, 1, 5, 60, 199])))
                 for _ in range(pick.randint(1, 7))]
        cells = {}
        for i in range(200):
            cell = sum(1 << k for k, ids in enumerate(lists) if i in ids)
            if cell:
                cells[cell] = cells.get(cell, 0) + 1
        assert filter_audit.merged(lists) == cells


def test_gallop_finds_the_first_place():
    ids = list(range(0, 300, 3))
    for start in (0, 1, 50, 99):
        for least in range(ids[start], 305):
            want = next((k for k in range(start, len(ids)) if ids[k] >= least), len(ids))
            assert filter_audit.gallop(ids, least, start) == want


def test_postings_are_sorted_and_bounded(spark):
    docs = [(i, "short", "hot") for i in range(500)]
    rows, known = tables(spark, docs, [])
    failed = filter_audit.failing(rows, known)
    lists = filter_audit.postings(failed, [*"ABCDE", "good", "toxic"]).collect()
    assert sum(len(r.rows_A) for r in lists) == 500 and sum(len(r.rows_E) for r in lists) == 499
    assert all(list(r.rows_A) == sorted(r.rows_A) for r in lists)
    assert all(x >> filter_audit.RANGE_BITS == r.range for r in lists for x in r.rows_A)


def test_nothing_fails_and_no_rows(spark):
    rows, known = tables(spark, [(1, " ".join(f"w{i}" for i in range(60)), "a")], [])
    got = found(filter_audit.audit(filter_audit.failing(rows, known)))
    assert len(got) == 600 and set(map(tuple, got.values())) == {(1, 0, 0, 0, 0, 0, 0)}
    rows, known = tables(spark, [], [])
    assert filter_audit.audit(filter_audit.failing(rows, known)).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "AAB")
