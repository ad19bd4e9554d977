"""The pipeline's stages, one after another on a small table, each against brute force on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from helpers import jaccard, sha, shingles, words
from lucera.llm import queries
from lucera.llm.common import Work, table


@pytest.fixture(scope="module")
def steps(spark, small):
    work, docs = Work(spark, "steps"), table(spark, small, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(work.save(stage(spark, out[-1], small), name))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_columns_stay(steps):
    for rows in steps[1:-1]:
        assert set(rows[0]) == set(steps[0][0])


def test_rules(spark, small, steps):
    kept = {r["doc_id"] for r in queries.QUERIES["op2_quality_rules"](spark, small).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in steps[1]) == sorted(kept)


def test_near_duplicates(steps):
    docs = sorted((r["doc_id"], r["text"]) for r in steps[1])
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] == docs[j][1] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in steps[2]) == [d for i, (d, _) in enumerate(docs) if find(i) == i]


def test_repeated_passages(steps):
    docs, first, expect = [(r["doc_id"], r["text"]) for r in steps[2]], {}, {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    for d, t in docs:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        left = t if all(keep) else " ".join(x for x, k in zip(w, keep) if k)
        if left:
            expect[d] = left
    assert {r["doc_id"]: r["text"] for r in steps[3]} == expect
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3] if r["text"] != dict(docs)[r["doc_id"]])


def test_mixture(steps):
    size, taken = defaultdict(int), Counter()
    for r in steps[3]:
        size[r["source"]] += len(words(r["text"]))
    for r in steps[4]:
        taken[r["source"]] += len(words(r["text"]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, open_ = {}, set(size)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] <= level * weight[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_ids(steps):
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in steps[5]) == Counter((r["doc_id"], sha(r["text"])) for r in steps[4])
