import random

import pytest

import corpus_pipeline
from lakeveil.llm import hashes, minhash, simhash
from tests.llm.frames import ROWS, empty, odd


def test_stages(spark, small):
    docs = odd(spark)
    good = corpus_pipeline.quality(spark, docs, small)
    assert good.columns == docs.columns and {(r.doc_id, r.text) for r in good.collect()} <= set(ROWS)
    assert all(r[c] == "clash" for r in good.collect() for c in docs.columns[4:])
    packed = corpus_pipeline.pack(spark, docs, small)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in ROWS})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixture", "packing"]
    exact = corpus_pipeline.exact(spark, docs, small)
    assert exact.columns == docs.columns
    # of equal texts the smallest id, and of repeated rows one; a run of white space is a space, not nothing
    assert sorted((r.doc_id for r in exact.collect())) == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    near = corpus_pipeline.near(spark, docs, small)
    assert near.columns == docs.columns and near.where("doc_id = 2").isEmpty() and near.where("doc_id is null").count() == 2
    mixed = corpus_pipeline.mixture(spark, docs, small)
    assert mixed.columns == docs.columns and mixed.count() <= len(ROWS)


@pytest.mark.parametrize("block", [256, 2])
def test_near_copies_by_jaccard(spark, block):
    """Against brute force: documents with words changed at several places, many of them more than 4 bits apart."""
    cache, rng = hashes.Words(), random.Random(5)
    rows = []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(5):
            text = list(words)
            for at in rng.sample(range(120), rng.randrange(7)):
                text[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    sets = [set(minhash.shingles(t, 5, cache).tolist()) for _, t in rows]
    near = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [p for p in near if bin(simhash.fingerprint(rows[p[0]][1]) ^ simhash.fingerprint(rows[p[1]][1])).count("1") > 4]
    assert len(far) > len(near) / 2
    label = list(range(60))
    for i, j in near * 5:
        label[i] = label[j] = min(label[i], label[j])
    later = minhash.later_copies(odd(spark, rows), block=block)
    assert {r.doc_id for r in later.collect()} == {i for i in range(60) if label[i] != i}
    kept = corpus_pipeline.near(spark, odd(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if label[i] == i}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_tables_pass(spark, small, stage):
    assert stage(spark, empty(spark), small).count() == 0


def test_quality_stage_follows_labels(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, small)
    assert kept.columns == docs.columns
    marks = labels.join(kept.select("doc_id"), "doc_id", "left_semi").collect()
    assert sum(r.quality for r in marks) >= 0.97 * len(marks)
    assert len(marks) >= 0.95 * labels.where("quality = 1").count()


def test_near_copies_are_found_by_simhash_too(spark):
    """A pair at the similarity that shares no MinHash band: fingerprints tell it, the exact sets decide; a fingerprint alone does not."""
    words = [f"s410w{i}" for i in range(90)] + ["again"] * 150
    other = [f"x{i}" if i in (40, 44) else w for i, w in enumerate(words)]
    unlike = [f"y{i}" if i < 40 else w for i, w in enumerate(words)] + ["again"] * 4000
    again = words + ["again"] * 4000
    rows = [(i, " ".join(x)) for i, x in enumerate([words, other, again, unlike])] + [(None, " ".join(words))]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and (prints[2] ^ prints[3]).bit_count() <= 4
    assert minhash.later_copies(odd(spark, rows[:2])).isEmpty()
    kept = corpus_pipeline.near(spark, odd(spark, rows), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 3, None]
