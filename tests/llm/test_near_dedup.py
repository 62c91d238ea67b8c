import random

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import near_dedup as near_dedup_module
from sluice.llm.components import connected_components
from sluice.llm.near_dedup import near_classes, near_dedup
from sluice.llm.prob_minhash import Shingler, signatures, similarity

WORDS = [a + b for a in "bcdfgklmnprst" for b in ("a", "e", "ond", "ist", "uf", "ing", "er")]


def slow_similarity(a, b):
    """The definition, term by term."""
    x, y = (dict(zip(k.tolist(), c.tolist())) for k, c in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def corpus(seed=0):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=55))
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(3, 300))) for _ in range(60)]
    texts += [passage + " " + " ".join(rng.choices(WORDS, k=rng.randint(5, 80))) for _ in range(40)]
    base = rng.choices(WORDS, k=150)
    for _ in range(60):  # a group of edited copies, some too far from the others
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += texts[:10] * 3 + ["", "", "  ", "one two", "one  two", "again " * 300, "again " * 290 + "end"]
    return texts


def test_similarity_and_signatures():
    rng, shingler = random.Random(5), Shingler()
    errors = []
    for _ in range(60):
        base = rng.choices(WORDS[: rng.choice([3, 90])], k=rng.randint(1, 200))
        other = [w if rng.random() > 0.03 else rng.choice(WORDS) for w in base]
        a, b = shingler(" ".join(base)), shingler(" ".join(other))
        assert abs(similarity(a, b) - slow_similarity(a, b)) < 1e-9
        s = signatures([a, b], 1024)
        errors.append(abs((s[0] == s[1]).mean() - similarity(a, b)))
    assert np.mean(errors) < 0.02 and max(errors) < 0.08
    alone = signatures([shingler("x y"), shingler("")], 64)
    assert len(set(alone[0])) == 1 and not alone[1].any()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 5), (200, 201), (7, 7)], "a int, b int")
    got = {r["node"]: r["class"] for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}
    assert connected_components(links.limit(0), "a", "b").collect() == []


def brute_force(rows):
    """The classes, by the definition: lists of row numbers."""
    shingler = Shingler()
    shingles = [shingler(t or "") for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or len(shingles[i][0]) and len(shingles[j][0]) and similarity(shingles[i], shingles[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def check(docs, rows):
    groups = brute_force(rows)
    ids = [[rows[i][0] for i in g] for g in groups]
    want = sorted(repr((k, min((x for x in g if x is not None), default=None), len(g))) for g in ids for k in g)
    got = near_classes(docs).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in got) == want
    assert sum(r.representative for r in got) == len(groups)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    return groups


def test_near_classes_match_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], None), (500, None, None), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert max(map(len, check(docs, rows))) > 30
    assert near_classes(docs.limit(0)).collect() == []
    assert near_dedup(docs.where(F.lit(False))).collect() == []


def test_blocks_smaller_than_a_group(spark, monkeypatch):
    """Half of all rows are edited copies of one text, many of them too far from its centre; no link may be lost between blocks."""
    monkeypatch.setattr(near_dedup_module, "BLOCK", 16)
    rng = random.Random(7)
    base = rng.choices(WORDS, k=120)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(5, 200))) for _ in range(120)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_null_and_empty_text_under_one_key_are_one_row(spark):
    rows = [(3, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (None, "x")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.text or "")) for r in got) == sorted(map(repr, [(3, ""), (4, "a b c d e f"), (None, "x")]))


def test_other_columns_may_have_any_name_and_type(spark):
    names = "doc_id long, text string, _kept int, _node string, id int, doc int, key int, node int, m map<string,int>"
    rows = [(1, "a b c d e f g", 1, "x", 2, 3, 4, 5, {"a": 1}), (2, "a b c d e f g", 1, "y", 2, 3, 4, 5, None)]
    docs = spark.createDataFrame(rows, names)
    got = near_dedup(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[0]]
