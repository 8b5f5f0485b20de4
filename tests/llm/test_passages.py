"""Repeated passages: against all pairs."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeveil.llm import common, hashes, minhash, passages
from tests.llm.frames import ROWS, empty, odd


def test_bands_are_tuned():
    assert hashes.tune_bands(0.8, 0.95) == 2 and hashes.tune_bands(0.8, 0.99) == 3
    assert hashes.tune_bands(0.8, 0.95, rows=4) == 6


def test_contents_are_alike_wherever_they_stand():
    cache, powers = hashes.Words(), passages.Powers(passages.BASES[0])
    import numpy as np

    one, two = cache.of(b"x y a b c d e".split()), cache.of(b"a b c d e z a c b d e".split())
    at = lambda h, s, e: int(passages.contents(h, np.array([s]), np.array([e]), powers)[0])
    assert at(one, 2, 7) == at(two, 0, 5) != at(two, 6, 11)


def test_places_that_hold_the_least_of_a_window():
    """Against all windows, ties too: the first of equal ones counts. Distinct values take no pass over the windows."""
    import numpy as np

    rng = np.random.default_rng(1)
    for most, n in ((2, 13), (5, 40), (50, 300), (1 << 60, 300), (1 << 60, 14)):
        for _ in range(50):
            x = rng.integers(0, most, n).astype(np.uint64)
            windows = np.lib.stride_tricks.sliding_window_view(x, 13)
            want = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
            assert passages.least_of_windows(x, 13).tolist() == want.tolist()
    one, other = np.uint64(5), rng.integers(0, 1 << 60, 9).astype(np.uint64)
    kept = other.copy()
    assert hashes.mix(other)[0] == hashes.mix(other[:1])[0] != one and (other == kept).all()


def test_repeated_passages(spark):
    shared = " ".join(f"shared{i * 7 % 61}q{i}" for i in range(70))
    text = lambda k: " ".join(f"own{k}n{i}" for i in range(80))
    tail = " ".join(f"tail{i}" for i in range(40))
    rows = [(1, text(1) + " " + shared + " " + text(2)), (2, shared + " " + tail), (3, text(3)), (4, text(4) + "\n" + shared), (5, None), (6, ""), (7, text(7)), (7, text(7)), (None, shared)]
    found = passages.repeated_passages(odd(spark, rows)).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.n_removed) for r in found} == {(1, 80, 70, 1, 0), (2, 0, 70, 1, 70), (4, 80, 70, 1, 70)}
    cut = {r.doc_id: r for r in passages.remove_passages(odd(spark, rows), passages.repeated_passages(odd(spark, rows))).collect() if r.doc_id}
    assert cut[3].text == text(3) and cut[4].text == text(4) and cut[2].text == tail and cut[4].spans == cut[4].p == "clash"
    assert cut[5].text is None and cut[6].text == ""
    assert passages.remove_passages(odd(spark, rows), passages.repeated_passages(odd(spark, rows))).columns == odd(spark).columns
    assert passages.repeated_passages(empty(spark)).count() == 0
    assert passages.remove_passages(empty(spark), passages.repeated_passages(empty(spark))).count() == 0


def test_odd_rows_and_repeated_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(docs.select("doc_id", F.lit("a short text under each id, of a few words only").alias("text"))).unionByName(docs.limit(20))
    texts = defaultdict(set)
    for r in both.collect():
        texts[r.doc_id].add((r.text or ""))
    for r in passages.repeated_passages(both).collect():
        assert any(r.start_word + r.n_words <= len(t.encode().split()) for t in texts[r.doc_id])
    # the long text and its copy with a tail, which are near lines
    found = {r.doc_id: (r.n_words, r.first_doc_id, r.n_removed) for r in passages.repeated_passages(odd(spark)).collect()}
    assert found == {1: (120, 1, 0), 2: (120, 1, 120), 6: (30_000, 6, 0), 12: (30_001, 6, 30_001)}
    assert len(odd(spark).collect()) == len(ROWS)


@pytest.mark.parametrize(("length", "edits", "least"), [(20, 0, 1), (21, 0, 1), (30, 0, 1), (35, 0, 1), (50, 0, 1), (50, 1, 0.98), (60, 1, 1), (100, 2, 0.98), (80, 3, 0.85)])
def test_recall_of_passages_inside_other_text(spark, length, edits, least):
    """Passages at any place of a line, some with changed words, each in two documents."""
    rng, rows = random.Random(length + edits), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for k in range(150):
        passage = [word() for _ in range(length)]
        for copy in range(2):
            p = list(passage)
            for at in rng.sample(range(length), edits if copy else 0):
                p[at] = word()
            rows.append((2 * k + copy, " ".join([*[word() for _ in range(rng.randrange(5, 40))], *p, *[word() for _ in range(30)]])))
    rows += [(1000 + k, " ".join(word() for _ in range(100))) for k in range(50)]
    found = {r.doc_id for r in passages.repeated_passages(odd(spark, rows)).collect()}
    assert len({2 * k + 1 for k in range(150)} & found) >= least * 150
    assert not any(i >= 1000 for i in found)


def by_all_pairs(docs, least):
    """For each text the words that stand in a run of ``least`` words or more of a smaller id, and these ids; and for each id the words that larger ones have."""
    at = defaultdict(list)
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - least + 1):
            at[tuple(w[k : k + least])].append((i, k))
    later, sources, first = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for places in at.values():
        i0, k0 = min(places)
        if any(i != i0 for i, _ in places):
            first[i0].update(range(k0, k0 + least))
            for i, k in places:
                if (i, k) != (i0, k0):
                    later[i].update(range(k, k + least))
                    for x in range(k, k + least):
                        sources[i][x].add(i0)
    return later, sources, first


def test_passages_by_brute_force(spark):
    """Passages of 20 to 90 words, each in two to six texts, some beside each other, some long enough for several rounds of edges."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared = [[word() for _ in range(n)] for n in (20, 25, 31, 40, 90, 300)]
    docs = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(3, 30))]]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            parts += [p, [word() for _ in range(rng.choice([0, 25]))]]
        words = [w for p in parts for w in p]
        docs.append((i, "\n".join(" ".join(words[k : k + 15]) for k in range(0, len(words), 15))))  # no line is long enough to be compared as one
    later, sources, first = by_all_pairs(docs, 20)
    removed, kept = defaultdict(set), defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        words = range(r.start_word, r.start_word + r.n_words)
        assert r.n_removed in (0, r.n_words)
        if r.n_removed:
            assert not removed[r.doc_id] & set(words)
            removed[r.doc_id].update(words)
            assert r.first_doc_id == min(s for x in words for s in sources[r.doc_id][x])
        else:
            assert r.first_doc_id == r.doc_id
            kept[r.doc_id].update(words)
    assert {i: x for i, x in removed.items() if x} == {i: x for i, x in later.items() if x}
    assert {i: x - later[i] for i, x in first.items() if x - later[i]} == {i: x - later[i] for i, x in kept.items() if x - later[i]}


def test_edges_have_no_end(spark):
    """A long passage whose runs are few, since its words are the same, is reported whole."""
    rng = random.Random(1)
    same = " ".join(["the"] * 700 + [f"end{k}" for k in range(9)])
    own = lambda k: " ".join(f"own{k}n{rng.randrange(10**9)}" for _ in range(50))
    found = passages.repeated_passages(spark.createDataFrame([(k, own(k) + " " + same + " " + own(k)) for k in range(3)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.n_removed) for r in found} >= {(1, 50, 709, 0, 709), (2, 50, 709, 0, 709)}


def test_long_copies_take_few_rounds(spark, monkeypatch):
    """A copy of a long text in which other texts' passages stand again and again, each with a first occurrence of its own."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [" ".join(word() for _ in range(9)) for _ in range(3)]
    long = "\n".join(" ".join([*[word() for _ in range(rng.randrange(12, 18))], rng.choice(common) if rng.random() < 0.3 else ""]) for _ in range(400))
    docs = [(0, "\n".join(f"{c} {word()} {word()}" for c in common)), (1, long), (2, f"{word()} {long} {word()}")]
    rounds, around = [], passages._surroundings
    monkeypatch.setattr(passages, "_surroundings", lambda *a: rounds.append(a[-1]) or around(*a))
    found = {(r.doc_id, r.start_word, r.n_words, r.n_removed) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    n = len(long.split())
    assert (2, 1, n, n) in found and rounds == [32 * 8**k for k in range(len(rounds))] and len(rounds) < 5


def test_a_text_of_one_word_takes_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs = [(k, f"{own(30)} {'the ' * n}{own(30)}") for k, n in enumerate((6000, 90, 20_000))]
    rounds, around = [], passages._surroundings
    monkeypatch.setattr(passages, "_surroundings", lambda *a: rounds.append(a[-1]) or around(*a))
    found = {(r.doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r.n_removed}
    assert (1, 30, 90) in found and (2, 30, 20_000) in found and len(rounds) < 4


def test_results_do_not_depend_on_the_rounds(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda: sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    want = rows()
    monkeypatch.setattr(passages, "REACH", 5)
    assert rows() == want and want


def test_batches_end_by_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 50, 1, 1, 0, 200, 3)] + [None]
    got = [b.column("text").to_pylist() for b in passages.by_bytes(iter([pa.RecordBatch.from_pydict({"text": texts})]), 60)]
    assert got == [texts[:5], texts[5:6], texts[6:]] and [t for b in got for t in b] == texts


def test_recall_against_all_pairs(spark, small):
    """Of all windows of 50 words, and of all pairs of lines with a Jaccard coefficient of 0.8."""
    cache = hashes.Words()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect()]
    docs += [(10_000 + i, "\n".join(" ".join(w if k % 25 else f"changed{i}" for k, w in enumerate(x.split())) for x in t.split("\n"))) for i, t in docs[:40]]
    at = defaultdict(set)
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            at[tuple(w[k : k + 50])].add(i)
    want = {i for s in at.values() if len(s) > 1 for i in s}
    lines = [(i, x) for i, t in docs for x in t.split("\n") if len(x.split()) >= 30]
    sets = [(i, set(passages.shingled(cache.of(x.encode().split()), 5).tolist())) for i, x in lines]
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i != j and len(a & b) >= 0.8 * len(a | b)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id for r in passages.repeated_passages(frame).collect()}
    assert want and len(want & found) >= 0.98 * len(want)
    assert len(pairs) > 50 and sum(i in found and j in found for i, j in pairs) >= 0.95 * len(pairs)


@pytest.mark.parametrize("shape", ["star", "path", "random", "none"])
def test_contraction_finds_components(spark, shape):
    from lakeveil.llm.components import components, contracted

    rng = random.Random(5)
    links = {"star": [(3, k) for k in range(4, 300)] + [(3, 3), (1, None), (2, 3)], "path": [(k * 37 % 211, (k + 1) * 37 % 211) for k in range(180)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "none": []}[shape]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert sorted(contracted(df).select("node", "component").collect()) == sorted(components(df).select("node", "component").collect())


def test_near_lines_are_clustered_through_hot_buckets(spark):
    """One bucket with a large component and a few that differ; small blocks exercise the pairs of blocks."""
    rows = [(i, 1) for i in range(40)]
    sets = [(i, list(range(10)) if i < 30 else list(range(100 * (i % 3), 100 * (i % 3) + 10))) for i in range(40)]
    links = minhash.linked(spark.createDataFrame(rows, "doc_id bigint, key bigint"), lambda ids: spark.createDataFrame(sets, "doc_id bigint, shingles array<bigint>"), 0.8, 3)
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {i: 0 if i < 30 or i % 3 == 0 else 31 if i % 3 == 1 else 32 for i in range(40)}


def test_words_of_a_batch_have_the_hashes_of_words_one_by_one():
    cache = hashes.Words()
    texts = ["", "one", " two\x0bwords ", "\n\n", "\u00fcber\u00a0alles \U0001f600 one", "", "a\tb\r\nc\x0cd", "one"]
    for part in (texts, texts[3:6], [""], [" "], texts * 3):
        for held in (pa.array(part), pa.array(["ahead", *part, "behind"])[1:-1], pa.array(part, pa.large_string())):
            h, at, edge, data = hashes.hashed_words(held)
            split = [t.encode().split() for t in part]
            assert h.tolist() == cache.of([w for words in split for w in words]).tolist()
            assert np.diff(np.searchsorted(at, edge)).tolist() == [len(words) for words in split]
            assert bytes(data) == "".join(part).encode() and edge.tolist() == np.cumsum([0, *(len(t.encode()) for t in part)]).tolist()
    assert len(hashes.hashed_words(pa.array([], pa.string()))[0]) == 0


def test_windows_count_in_their_own_text_only():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(0, 60, 9)
        start = np.cumsum([0, *(sizes[:-1] + passages.SHINGLE)])
        h = rng.integers(1, 4, start[-1] + sizes[-1] + passages.SHINGLE).astype(np.uint64)
        alone = [s + passages.chosen(np.append(h[s : s + n], np.zeros(passages.SHINGLE, np.uint64)), np.array([0]), np.array([n])) for s, n in zip(start, sizes, strict=True)]
        assert passages.chosen(h, start, start + sizes).tolist() == np.concatenate(alone).tolist()


class Mapped:
    """Takes what would be run on the batches of a table."""

    def mapInArrow(self, run, schema):
        self.run = run


def test_memory_of_runs_and_lines_does_not_grow_with_the_distinct_words():
    rows = [" ".join(f"{i:03d}word{k:05d}" for k in range(2_000)) for i in range(300)]  # 600,000 words, all of them distinct
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text_hash": list(range(300)), "text": rows})
    table = Mapped()
    passages._paragraphs(table, 5)
    tracemalloc.start()
    assert sum(b.num_rows for b in table.run(iter([batch]))) == 300
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


def test_texts_reach_python_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(3_000, numPartitions=1).select(F.repeat(F.lit("words "), 1_000).alias("text"))  # 18 MB in one task
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with common.batches_of(spark, passages.BATCH):
        assert max(r.n for r in rows.mapInArrow(sizes, "n bigint").collect()) < 6_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
