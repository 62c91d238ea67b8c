"""Spelling variants, source mixing and collocations against brute force on planted rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import collocations as c13
from sluice.llm import spelling
from sluice.llm.collocations import collocations, frequent_phrases, lcp_intervals, suffix_array
from sluice.llm.mixing import mix_decisions, mix_documents
from sluice.llm.spelling import letter_value, near_pairs, neighbour_keys, spelling_variants, word_counts

DOCS = "doc_id long, text string, lang string, source string, `a.b` int, n long, word string, taken int, _key int, _row long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, 1, 2, "w", 3, 4, 5) for k, t, lang, source in rows], DOCS)


# Spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, slip):
    n = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: x for w, x in n.items() if len(w) >= 6 and x >= 5}


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-words[o], o) for o in words if one_apart(w, o))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = (n, len(near), form and form[1], form and -form[0])
    result = []
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        result.append((w, n, k, form, form_n, root))
    return sorted(result)


def spelling_rows():
    rng = random.Random(5)
    stems = ["abcabcab", "aaaaaaa", "bananas", "École", "éàçüöß", "letters", "cabbages", "aabbaabb"]
    pool = []
    for i, s in enumerate(stems):
        pool += [s] * (3000 // 5**(i % 5))
        for _ in range(60):
            at = rng.randrange(len(s))
            pool += [rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice("abcé×") + s[at:], s[:at] + rng.choice("abzÉ") + s[at + 1 :]])] * rng.choice([1, 5, 6, 30])
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[i::40]) + "_x9", "en", "s") for i in range(40)]
    rows += [(None, "letters letterz Letterz LETTERZ", "en", "s"), (41, None, None, None), (42, "", "de", "s"), (43, "y" * 3000 + " " + ("y" * 2999 + " ") * 30, "en", "s")]
    return rows + [(7, rows[7][1], "en", "s")] * 2 + [(44, ("ab" * 3 + ".") * 5 + ("x" * 3000 + " ") * 6, "en", "s")]


@pytest.mark.parametrize("slip", [None, 7])
def test_variants_match_brute_force(spark, slip):
    rows = spelling_rows()
    words = brute_words(rows, slip)
    got = spelling_variants(word_counts(table(spark, rows), slip=slip)).collect()
    want = brute_variants(words)
    assert sorted(map(tuple, got)) == want
    assert any(r[3] for r in want)


def test_chains_of_forms_are_followed_to_the_end(spark):
    words = [("aaaaaa" + "b" * i, 5**(9 - i)) for i in range(9)] + [("zzzzzzz", 7)]
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(got["aaaaaa" + "b" * i] == ("aaaaaa" + "b" * (i - 1), "aaaaaa") for i in range(1, 9)) and got["zzzzzzz"] == (None, "zzzzzzz")
    with pytest.raises(ValueError, match="ratio"):
        spelling_variants(spark.createDataFrame(words, "word string, n long"), ratio=1)


def test_each_pair_is_found_once(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8]))) for _ in range(200)})
    pairs = [tuple(sorted((r.one, r.other))) for r in near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    assert sorted(pairs) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_apart(a, b))


def test_letter_values_tell_exchanges_apart():
    letters = [chr(x) for x in (*range(97, 123), *range(0xC0, 0x100))]
    differences = [letter_value(a) - letter_value(b) for a in letters for b in letters if a != b]
    assert len(set(differences)) == len(differences)
    assert len(list(neighbour_keys("abc" * 100_000))) <= 14  # by different letters, not by length


# Mixing


def brute_targets(sizes):
    """sizes: words of each source, in order."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if share * weights[i] >= 3 * sizes[i]}
        if not above:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in above:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        open_ -= above
    return target


def mixing_rows():
    rng = random.Random(2)
    rows = []
    for i, source in enumerate(["", "a", "b", "c", "é", "z", None]):
        rows += [(1000 * i + j, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), "en", source) for j in range([3, 900, 40, 40, 5, 300, 60][i])]
    rows += [(None, "a b\tc\n\x0bd\x0c\re\xa0f g", "en", "a"), (9, None, None, "b"), (9, "", "en", "b"), (10, "x " * 30_000, "en", "z"), (11, "", "en", "none"), (12, None, "en", "none")]
    return rows + [(1005, "same words", "en", "a")] * 50


def test_mix_matches_brute_force(spark):
    rows = mixing_rows()
    got = mix_decisions(table(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id is None, r.doc_id), r.size) for r in got) == sorted(((k is None, k), size(t)) for k, t, *_ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    totals = [sum(size(t) for _, t, _, s in rows if s == name) for name in names]
    want = brute_targets(totals)
    source_of = {(k, size(t)): s for k, t, _, s in rows}
    by_source = {}
    for r in got:
        by_source.setdefault(source_of[r.doc_id, r.size], []).append(r)
    for name, total, target in zip(names, totals, want, strict=True):
        mine = by_source[name]
        assert {r.source_size for r in mine} == {total} and all(abs(r.target - target) < 1e-6 * max(1, target) for r in mine)
        taken = sum(r.taken for r in mine)
        assert abs(taken - target) <= max(r.size for r in mine) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in mine)
        if total:
            expected = target / total
            assert {r.copies for r in mine} <= {int(expected), int(expected) + 1}
            assert abs(sum(r.copies for r in mine) - expected * len(mine)) < 1 + 1e-6
    assert sum(want) == pytest.approx(sum(totals)) and target == 0 or total


def test_mix_is_the_same_however_partitioned(spark):
    docs = table(spark, mixing_rows())
    first, second = (sorted(map(str, mix_decisions(d).collect())) for d in (docs.repartition(7), docs.coalesce(1)))
    assert first == second != sorted(map(str, mix_decisions(docs, seed="other").collect()))
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.where("text is not null").groupBy("doc_id").count().collect()}
    decided = mix_decisions(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).where("c > 0").collect()
    assert {k: v for k, v in counts.items() if k not in (9, 12)} == {r.doc_id: r.c for r in decided if r.doc_id not in (9, 12)}


def test_mixing_needs_no_python_worker(spark):
    plan = mix_decisions(table(spark, mixing_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    with pytest.raises(ValueError, match="weights"):
        mix_decisions(table(spark, mixing_rows()), weights=(1, 0))


# Collocations


def brute_collocations(rows, min_count=10, top=2000, longest=3):
    counts = {}
    for _, t, lang, _ in rows:
        n = counts.setdefault(lang or "und", Counter())
        t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                n.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in counts.items():
        total = sum(x for g, x in n.items() if len(g) == 1)
        often = {g: x for g, x in n.items() if len(g) > 1 and x >= min_count}
        found = []
        for g, a in often.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * x >= 50 * a for h, x in often.items()):
                continue
            score, cut = min((10**6 * a * a // (n[g[:i]] * n[g[i:]]), i) for i in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), n[g[:cut]], n[g[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "New", "york", "city", "É", "é", "a b", "x y", "ß", "of"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(60)), rng.choice(["en", "de", None, "und"]), "s") for i in range(40)]
    rows += [(50, "new york city " * 400, "fr", "s"), (51, "q " * 300 + "q.", "fr", "s"), (52, "one two three four " * 15, "es", "s"), (53, "one two. " * 16, "es", "s")]
    return rows + [(60, None, None, None), (61, "", "xx", "s"), (62, " .,;\t\n", "yy", "s"), (None, "same same", "en", "s")] + [(7, "twice told tales", "en", "s")] * 12


@pytest.mark.parametrize("block", [4, 50, 2_000_000])
def test_collocations_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(c13, "BLOCK_WORDS", block)
    rows = phrase_rows()
    got = collocations(frequent_phrases(table(spark, rows).repartition(3))).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows)


def test_longer_phrases_and_small_tops(spark):
    rows = phrase_rows()
    got = collocations(frequent_phrases(table(spark, rows), max_words=4, min_count=5), top=3, longest=4).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 5, 3, 4)


def test_suffix_intervals_count_phrases():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 5, 500).astype(np.int32)
    order = suffix_array(ids, 4)
    keys = [tuple(ids[i : i + 4]) for i in order]
    assert keys == sorted(keys)
    want = Counter(tuple(ids[i : i + k]) for k in (1, 2, 3) for i in range(490) if i + k <= 500 and 1 not in ids[i : i + k])
    got = Counter()
    for found, n in lcp_intervals(ids, (1, 2, 3), 490):
        got.update({tuple(g): int(x) for g, x in zip(found.T, n, strict=True)})
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**14
    rows = [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "", 0, 10**15)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    (r,) = collocations(phrases).collect()
    assert r.score == 10**6 * (big - 1) ** 2 // (big * (big + 7)) and (r.l, r.r, r.n) == (big, big + 7, 10**15)


def test_slices_of_long_texts_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 10)
    monkeypatch.setattr(c13, "SLICE", 10)
    text = " ".join(["abc", "d" * 30, "É.x", "", "tail\tend"] * 5)
    parts = list(spelling._slices(text, re.compile("[^A-Za-zÀ-ÿ]")))
    assert "".join(parts) == text and len(parts) > 5 and [w for p in parts for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", text)
    words = [w for p in c13._parts(text.encode()) for w in p.split(b" ") if w]
    assert words == text.encode().translate(c13.TABLE).replace(b".", b" . ").split() + [b"."]


def test_empty_tables(spark):
    empty = table(spark, []).where("false")
    assert spelling_variants(word_counts(empty)).collect() == []
    assert mix_decisions(empty).collect() == [] and mix_documents(empty).collect() == []
    assert collocations(frequent_phrases(empty)).collect() == []
