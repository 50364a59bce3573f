import random

import numpy as np

from netquarry.llm import leakage as L

DOC = "doc_id long, text string, score double"
ITEM = "item_id long, text string"


def common(a, b, n=12):
    a, b = L.words(a), L.words(b)
    grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
    return any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1))


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(40)] + ["the", "of"] * 10
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 30, 80])))) for i in range(20)] + [(90, None), (91, "")]
    items.append((92, " ".join(items[3][1].split()[:3]) + " " + items[2][1]))
    docs = []
    for d in range(80):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            src = rnd.choice(items[:20])[1].split()
            n = rnd.choice([11, 12, 13, 40])
            k = rnd.randrange(max(1, len(src) - n))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = src[k : k + n]
        docs.append((d, rnd.choice([" ", "\n  ", "_-"]).join(x.upper() if rnd.random() < 0.2 else x for x in w), 0.0))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (1002, "ä " * 1000, 0.0), docs[0], (None, items[2][1], 0.0)]
    it, dd = spark.createDataFrame(items + items[:3], ITEM), spark.createDataFrame(docs, DOC)
    got = L.leaks(it, dd).filter("run >= 12").collect()
    want = {(i, d) for i, a in items if a for d, b, _ in docs if b and d is not None and common(a, b)}
    assert {(r.item_id, r.doc_id) for r in got} == want and len(got) == len(want) > 10
    assert L.leaks(it.limit(0), dd).count() == 0 and L.leaks(it, dd.limit(0)).count() == 0


def test_edited_copy_scores(spark):
    item = " ".join(f"word{k}" for k in range(60))
    w = item.split()
    w[20] = "changed"
    del w[40]
    got = L.leaks(spark.createDataFrame([(1, item)], ITEM), spark.createDataFrame([(1, "x y z " + " ".join(w), 0.0)], DOC)).collect()
    assert len(got) == 1 and got[0].score == 58 - 1 - 1 and got[0].run == 20


def test_copy_with_an_edit_in_every_window(spark):
    items, docs, want = [], [], {}
    for gap in (8, 9, 10, 11):  # each item has one copy, so what its edits broke stands in no document
        item = [f"item{gap}word{k}" for k in range(100)]
        copy = ["new" if k % gap == gap - 1 else w for k, w in enumerate(item)]
        items.append((gap, " ".join(item)))
        docs.append((gap, " ".join(copy), 0.0))
        score, run = full([list(range(100))], [[-1 if w == "new" else k for k, w in enumerate(copy)]])
        want[gap, gap] = (score[0], run[0])
    got = L.leaks(spark.createDataFrame(items, ITEM), spark.createDataFrame(docs, DOC)).collect()
    assert {(r.item_id, r.doc_id): (r.score, r.run) for r in got} == want and all(score >= 16 and run < 12 for score, run in want.values())


def full(a, b):
    """Smith-Waterman over whole texts, cell by cell."""
    scores, runs_ = [], []
    for x, y in zip(a, b, strict=True):
        h = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        best = longest = 0
        runs = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                eq = x[i - 1] == y[j - 1]
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if eq else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                runs[i][j] = runs[i - 1][j - 1] + 1 if eq else 0
                best, longest = max(best, h[i][j]), max(longest, runs[i][j])
        scores.append(best)
        runs_.append(longest)
    return scores, runs_


def test_banded_alignment_equals_plain_smith_waterman():
    rnd = random.Random(1)
    a = [[rnd.randrange(4) for _ in range(9)] for _ in range(30)]
    b = [[rnd.randrange(4) for _ in range(12)] for _ in range(30)]
    wide = np.array([[-1] * 12 + x + [-1] * 9 for x in b])  # a band that holds every cell
    score, run = L._align(np.array(a), wide, 1.0, 1.0, 1.0)
    assert (list(score), list(run)) == full(a, b)


def test_edited_copies_are_found(spark):
    """Recall of copies of 30 to 60 words by share of words that were replaced, dropped or added, among all whose score reaches 16."""
    rnd = random.Random(5)
    items = [(i, [f"i{i}w{k}" if rnd.random() < 0.6 else rnd.choice(["the", "of", "for", "in", "return", "x"]) for k in range(90)]) for i in range(60)]
    docs, pairs = [], []
    for rate in (0.05, 0.1, 0.15, 0.2):
        for i, w in items:
            k = rnd.randrange(30)
            copy = []
            for x in w[k : k + rnd.randrange(30, 61)]:
                u = rnd.random()
                if u >= rate:
                    copy.append(x)
                elif u < 0.6 * rate:
                    copy.append(f"new{rnd.randrange(999)}")
                elif u < 0.8 * rate:
                    copy += [x, "added"]
            doc = len(docs)
            docs.append((doc, " ".join(["before"] * 20 + copy + ["after"] * 20), 0.0))
            pairs.append((rate, i, doc, copy))
    ids = lambda words: [hash(x) for x in words]
    scores, _ = full([ids(items[i][1]) for _, i, _, _ in pairs], [ids(c) for *_, c in pairs])
    got = {(r.item_id, r.doc_id): r.score for r in L.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM), spark.createDataFrame(docs, DOC)).collect()}
    for rate in (0.05, 0.1, 0.15, 0.2):
        due = [(i, d, s) for (r, i, d, _), s in zip(pairs, scores, strict=True) if r == rate and s >= 16]
        recall = sum(got.get((i, d), 0) >= 16 for i, d, _ in due) / len(due)
        print(rate, len(due), recall)
        assert recall >= 0.95
        assert all(got[i, d] == s for i, d, s in due if (i, d) in got)


def test_items_in_blocks(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(12)]
    docs = [(i, f"a b {items[i][1]} c", 0.0) for i in range(12)]
    it, d = spark.createDataFrame(items, ITEM), spark.createDataFrame(docs, DOC)
    want = {(i, i, 30.0, 30) for i in range(12)}
    for size in (32_000_000, 500):  # all at once, and one more item than a block holds several times over
        assert {(r.item_id, r.doc_id, r.score, r.run) for r in L.leaks(it, d, block_bytes=size).collect()} == want
