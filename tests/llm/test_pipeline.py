import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm.labelled import fold
from sluice.llm.packing import cut_lengths
from sluice.llm.prob_minhash import Shingler, similarity
from sluice.llm.quality import NGrams, fit_quality
from sluice.llm.toxicity import Words, fit_toxicity

SF = "/root/testdata/sf0.001"


def survivors(docs, labels):
    """The first four stages in plain Python; only the two models are fitted by the library."""
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic, words = fit_toxicity(docs, labels, fold("doc_id", 5) != 0), None
    words = Words(only=toxic.index)
    rows = {k: t for k, t in rows.items() if toxic.score(words(t)) < 0.5}
    left = docs.where(F.col("doc_id").isin(list(rows)))
    quality, grams = fit_quality(left, labels, fold("doc_id", 3) != 1), NGrams()
    rows = {k: t for k, t in rows.items() if quality.score(grams(t)) >= 0.5}
    last = {}
    for k in sorted(rows):
        last[rows[k]] = k
    rows = {k: rows[k] for k in sorted(last.values())}
    shingler = Shingler()
    shingles = {k: shingler(t) for k, t in rows.items()}
    group = {k: k for k in rows}
    for a in rows:
        for b in rows:
            if a < b and len(shingles[a][0]) and len(shingles[b][0]) and similarity(shingles[a], shingles[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {k: rows[k] for k, g in group.items() if k == g}


def test_pipeline_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = survivors(docs, labels)
    assert 0 < len(want) < docs.count()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for k, text in want.items():
        ids, start = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for i, n in enumerate(cut_lengths(len(ids), 2048)):
            pieces.append((k, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in members) <= 2048 for members in by.values())


def test_a_run_leaves_nothing_but_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sluice.workspace.shared_dir", lambda spark: str(tmp_path / "shared"))
    got = corpus_pipeline.run(spark, SF)
    (left,) = (tmp_path / "shared").iterdir()
    assert left.name.startswith("stage-packing") and got.count() > 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("node", F.lit("x")).withColumn("a.b", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs.limit(50), docs.limit(0)):
            out = stage(spark, some, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= some.count()
