"""SimHash, passages, classifier, sharding, scoring and packing: against brute force."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeveil.llm import golay, lm_score, packing, ppm, quality_model, sharding, simhash
from tests.llm.frames import LONG, ROWS, empty, no_labels, odd


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    own, near = golay.keys(words)
    for errors in (1, 2):
        for k in range(500):
            other = words[k] ^ sum(1 << int(b) for b in rng.choice(23, errors, replace=False))
            own2, near2 = golay.keys(np.array([other]))
            assert set(near[k]) & set(near2[0])
            assert errors == 2 or (own2[0] in near[k] and own[k] in near2[0])


def test_fingerprint_is_the_bitwise_majority():
    for text in ("a b c", "One two THREE four five six", LONG[:3000]):
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def brute_components(prints, most=4):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[i] > label[j] and bin(prints[i] ^ prints[j]).count("1") <= most:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("block", [2048, 16])
def test_near_links_find_every_component(spark, block):
    """Random centres with chains of neighbours; small blocks exercise the split of large keys."""
    rng = np.random.default_rng(3)
    prints, at = {}, 0
    for _ in range(6):
        value = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            prints[at], at = value, at + 1
            value ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False))
    centre = int(rng.integers(0, 1 << 63))
    for k in range(60):
        prints[at], at = centre ^ (1 << k), at + 1
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in prints.items()]
    links = simhash.near_links(spark.createDataFrame(rows, "fp bigint, rep bigint"), block=block)
    found = {r.node: r.component for r in simhash.components(links).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_more_bits_than_the_keys_cover_are_rejected(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd(spark), most=5)


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_classifier(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    scored = quality_model.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    odd_rows = quality_model.score_documents(odd(spark), labels).collect()
    assert len(odd_rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd_rows)
    assert {r.score for r in quality_model.score_documents(odd(spark), no_labels(spark)).collect()} == {0.5}
    assert quality_model.score_documents(empty(spark), labels).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """The dual's value meets the primal's: sum of alphas - |w|^2 / 2 against |w|^2 / 2 + hinge losses."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 20, 6)) for _ in range(80)]
    y = np.where(np.array([len(set(r) & set(range(8))) for r in rows]) + rng.normal(0, 1, 80) > 2.5, 1.0, -1.0)
    top = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * 40

    def primal(w, b):
        m = np.array([w[r].sum() / np.sqrt(len(r)) + b for r in rows])
        return (w @ w + b * b) / 2 + (top * np.maximum(0, 1 - y * m)).sum()

    w, b = quality_model.dual_coordinate_descent(rows, np.ones(20), y, rounds=400)
    best = primal(w, b)
    for _ in range(300):  # no step from it does better
        assert primal(w + rng.normal(0, 0.02, 20), b + rng.normal(0, 0.02)) >= best - 1e-3
    w2, b2 = quality_model.dual_coordinate_descent(rows, np.ones(20), y, rounds=12)
    assert primal(w2, b2) <= best * 1.05


def test_scores_follow_plain_log_count_ratios(spark):
    """Class log-count ratios restated over dictionaries: fitted scores fall on their side."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["good", "fine", "plain", "calm"] if i % 2 else ["bad", "BUY", "plain", "now!!"], k=12))) for i in range(120)]
    docs = odd(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality_model.score_documents(docs, labels).collect()}
    cache, fold = quality_model.Words(), lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    sets = {i: quality_model.indicators(t, cache).tolist() for i, t in rows}
    good, bad = (Counter(k for i, _ in rows if not fold(i) and i % 2 == y for k in sets[i]) for y in (1, 0))
    size = quality_model.SIZE
    ratio = lambda k: math.log((good[k] + 1) / (sum(good.values()) + size)) - math.log((bad[k] + 1) / (sum(bad.values()) + size))
    lean = {i: sum(ratio(k) for k in s) / math.sqrt(sum(ratio(k) ** 2 for k in s)) for i, s in sets.items()}
    # the fitted scores order the documents as the plain ratios do, and separate the held-out ones
    assert all((got[i] >= 0.7) == bool(i % 2) for i, _ in rows if fold(i))
    assert all((lean[i] > 0) == (got[i] > 0.5) for i, _ in rows)


def test_fit_takes_bounded_bytes(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    monkeypatch.setattr(quality_model, "FIT_BYTES", 60_000)
    rows = quality_model.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.7 * len(rows)


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, f"text {i % 50}" if i % 3 else "hot") for i in range(500)] + ROWS
    got = sharding.shard_documents(odd(spark, rows), shards=7).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_few_rows_move_to_a_new_shard():
    for a, b in ((8, 9), (24, 25)):
        counts = {}
        one, two = sharding.owners(a, 32), sharding.owners(b, 32)
        scale = max(len(one), len(two))
        moved = sum(one[c * len(one) // scale] != two[c * len(two) // scale] for c in range(scale)) / scale
        assert moved < 3 / b
        counts = {c: 3 for c in range(0, len(one), 2)}
        sent = sharding.plan_cells(one, counts, sharding.capacities(sum(counts.values()), a))
        assert all(sum(n for _, n in sent[c]) == counts[c] for c in counts)


def test_rows_go_on_clockwise_only_past_full_shards(spark):
    """The ring restated: a row lies on the first shard from its cell on that is not full without it."""
    rows = [(i, f"text {i % 90}" if i % 3 else "hot") for i in range(700)]
    docs = odd(spark, rows)
    got = {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=7, vnodes=8).collect()}
    owner, bits = sharding.owners(7, 8), sharding.ring_bits(7, 8)
    points = sorted((int.from_bytes(__import__("hashlib").sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(7) for v in range(8))
    full = {s for s, n in Counter(got.values()).items() if n >= sharding.capacities(700, 7)[s]}
    assert full == set(range(7))  # capacities sum to the rows
    cells = {r.doc_id: (r.place >> (64 - bits)) + len(owner) // 2 for r in docs.select("doc_id", F.xxhash64("text").alias("place")).collect()}
    home = {i: next((s for p, s in points if p >> (64 - bits) >= c), points[0][1]) for i, c in cells.items()}
    assert all(owner[cells[i]] == home[i] for i in home)
    moved = {s: [i for i in got if home[i] == s and got[i] != s] for s in range(7)}
    room = {s: sum(v == s and home[i] != s for i, v in got.items()) for s in range(7)}
    # a shard that sends rows on takes none in but what its own rows in earlier cells left
    assert all(not moved[s] or sum(home[i] == s for i in got) > sharding.capacities(700, 7)[s] - room[s] for s in range(7))


@pytest.mark.parametrize(("hot", "most"), [(0, 0.12), (1 / 3, 0.16)])
def test_movement_of_planned_loads(hot, most):
    """Shares of rows that change their shard from 24 to 25 shards, as planned with full shards."""
    rng, rows = random.Random(6), 60_000
    keys = [rng.getrandbits(64) for _ in range(rows)]
    keys = [keys[0] if k < rows * hot else x for k, x in enumerate(keys)]

    def placed(shards):
        owner, bits = sharding.owners(shards, 32), sharding.ring_bits(shards, 32)
        cells = sorted((k >> (64 - bits), k, i) for i, k in enumerate(keys))
        sent = sharding.plan_cells(owner, Counter(c for c, _, _ in cells), sharding.capacities(rows, shards))
        out, at = {}, Counter()
        for c, _, i in cells:
            n, upto = at[c], 0
            at[c] += 1
            for s, k in sent[c]:
                upto += k
                if n < upto:
                    out[i] = s
                    break
        return out

    one, two = placed(24), placed(25)
    assert 0.04 <= sum(one[i] != two[i] for i in range(rows)) / rows <= most


def brute_ppm(train, text, order=5):
    """Byte by byte: method D escapes, exclusion of what a longer context has, bytes never seen equally likely."""
    edge, counts = b"\xff", {}
    for t in train:
        data = edge * order + t + edge
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total, data = 0.0, edge * order + text + edge
    for i in range(order, len(data)):
        excluded: set = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in excluded}
            if not left:
                continue
            z = sum(left.values())
            if data[i] in left:
                total += math.log10((left[data[i]] - 0.5) / z)
                break
            total += math.log10(len(left) / 2 / z)
            excluded |= set(left)
        else:
            total -= math.log10(256 - len(counts.get(b"", ())))
    return total


def test_scores_equal_a_plain_byte_model(spark):
    rng = random.Random(2)
    words = ["the", "cat", "Sat", "on", "mat", "é漢", "a", "aa", "aaa", "\n", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25))) + rng.choice(["", "!", "qz"])) for i in range(60)] + [(None, "no id"), (99, None), (99, "")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [(t or "").encode() for i, t in rows if not held(i)]
    want = Counter((i, round(brute_ppm(train, (t or "").encode()), 3)) for i, t in rows)
    got = Counter((r.doc_id, round(r.score, 3)) for r in lm_score.score_documents(odd(spark, rows)).collect())
    assert sum((want - got).values()) <= 2  # sums that round the other way


def test_chunks_end_by_rows(spark, monkeypatch):
    """Blank rows add neither bytes nor words."""
    monkeypatch.setattr(lm_score, "CHUNK_ROWS", 10)
    got = lm_score.score_documents(odd(spark, [(i, None if i % 2 else "") for i in range(95)])).collect()
    assert len(got) == 95 and len({r.base_score for r in got}) == 1


@pytest.mark.parametrize("slice_size", [2, 5])
def test_scores_by_a_tree_of_chunks(spark, small, monkeypatch, slice_size):
    """Dictionaries that meet a few a task, in several rounds, give what they give all at once."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(None, "e e e e " * 500), (5000, None), (5001, "\x00\xff e")], "doc_id bigint, text string"))
    scores = lambda: sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm_score.score_documents(docs).collect())
    want = scores()
    monkeypatch.setattr(lm_score, "CHUNK_ROWS", 15)
    monkeypatch.setattr(lm_score, "SLICE", slice_size)
    assert scores() == want and len(want) == docs.count()


def test_byte_model_sums_to_one_and_predicts():
    texts = [("the cat sat on the mat " * k).encode() for k in range(1, 30)]
    code, _ = ppm.codes(texts)
    top, n = np.unique(code, return_counts=True)
    key, count = ppm.count_levels(top, n.astype(np.int64))
    low = np.uint64((1 << 56) - 1)
    context, at = np.unique(((key & low) >> np.uint64(8)) | (key & ~low), return_inverse=True)
    total = np.bincount(at, count)
    for least in (1, 5):
        keep = count >= least
        has = np.isin(context, (((key & low) >> np.uint64(8)) | (key & ~low))[keep])
        model = ppm.Model.of(ppm.Model(key[keep], count[keep], context[has], total[has]).arrays())
        for c in [int(x) >> 8 for x in code[:80]] + [0, 12345, (1 << 40) - 1]:
            sums = (10 ** model.code_lengths(np.array([(c << 8) | s for s in range(256)], np.uint64))).sum()
            assert sums == pytest.approx(1, abs=1e-4)
        good, bad = model.score([b"the cat sat on the mat ", b"qzx vkj wpf dbg hum yl "])
        assert good > bad / 3


def test_lm_scores(spark):
    rows = lm_score.score_documents(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(x for i, t in ROWS if not held(i) for x in tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), total, round(sum(float(np.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1)))) for x in tokens(t)), 3)) for i, t in ROWS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_byte_model_keeps_every_gram(spark):
    """The scores of one model over all grams, of which there are more than 2^20."""
    rng = np.random.default_rng(3)
    rows = [(i, bytes(rng.integers(97, 123, 20_000, np.uint8)).decode()) for i in range(40)]
    rows += [(100 + i, rows[i][1][:50] + "é漢 x" + rows[i + 9][1][:9]) for i in range(20)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    code, n = np.unique(ppm.codes([t.encode() for i, t in rows if i not in held])[0], return_counts=True)
    key, count = ppm.count_levels(code, n.astype(np.int64))
    assert len(key) > 1 << 20 and held
    want = ppm.Model.whole(key, count).score([t.encode() for _, t in rows])
    got = {r.doc_id: r.score for r in lm_score.score_documents(odd(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), rel=1e-5)


def test_encoder_equals_the_tokenizer(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert encode.fast
    texts = [t or "" for _, t in ROWS] + ["it's  WE'LL x'S 3.14 <|endoftext|> àÀß ÿ×÷ naïve", "é İ ŉ ﬁ"] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing_round_trip(spark):
    packed = packing.pack_documents(odd(spark), with_ids=True, block=8)
    rows = packed.collect()
    made = {}
    for r in rows:
        assert r.length <= 2048 and len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in made.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    encode = packing.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    whole = Counter((i, zlib.crc32(encode(t or "") + bytes(4))) for i, t in ROWS)
    single = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.piece)):
        if r.doc_id not in (None, 7):
            single[r.doc_id] = single.get(r.doc_id, b"") + bytes(r.ids)
    assert all((i, zlib.crc32(x)) in whole for i, x in single.items())
    assert sum(r.length for r in rows) == sum(len(encode(t or "")) // 4 + 1 for _, t in ROWS)
    assert packing.sequences(packed).count() == len(made)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_genetic_steps_keep_every_piece():
    rng = random.Random(5)
    sizes = [rng.randint(1, 1400) for _ in range(300)]
    people = packing.start_population(sizes, 2048, 1, 3)
    best = packing.evolve(sizes, people, 2048, 2, 20)[0]
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert len(best) <= min(map(len, people)) and len(best) <= -(-sum(sizes) // 2048) * 1.03 + 1


def test_lower_bound_of_bins():
    assert packing.least_bins([1500] * 4 + [600] * 4, 2048) == 6  # no 600 beside a 1500, three in a bin
    assert packing.least_bins([1100] * 5, 2048) == 5 and packing.least_bins([10, 20], 2048) == 1 and packing.least_bins([], 2048) == 0
    rng = random.Random(3)
    for _ in range(50):  # never above a packing that exists
        bins = [[rng.randint(1, 700) for _ in range(3)] for _ in range(20)]
        assert packing.least_bins([x for b in bins for x in b], max(map(sum, bins))) <= 20


@pytest.mark.parametrize(("low", "high", "saved", "swaps"), [(300, 900, 0.015, False), (500, 1400, 0.008, True)])
def test_evolution_needs_fewer_bins_than_every_start(low, high, saved, swaps):
    """Where best-fit decreasing is far from the bound; by crossover alone, too (of large pieces with the swaps of displaced ones)."""
    rng = random.Random(7)
    sizes = [rng.randint(low, high) for _ in range(1024)]
    people = packing.start_population(sizes, 2048, 1, 8)
    start = min(map(len, people))
    assert start == len(people[0])  # the first is best-fit decreasing
    assert len(packing.evolve(sizes, people, 2048, 2, 100)[0]) <= start * (1 - saved)
    assert len(packing.evolve(sizes, people, 2048, 2, 300, mutation=False, swaps=swaps)[0]) < start


def test_hard_sizes_through_spark(spark):
    rng = random.Random(9)
    rows = [(i, 0, rng.randint(300, 900)) for i in range(2000)]
    packed = packing.pack_pieces(spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint"), block=512, merged=300).collect()
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    plain: list = []
    packing.best_fit([n for _, _, n in rows], list(range(2000)), plain, [], 2048)
    assert len(packed) == 2000 and max(used.values()) <= 2048
    assert len(used) < 0.985 * len(plain) and len(used) <= 1.012 * sum(n for _, _, n in rows) / 2048


def test_encoder_on_random_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x100)]] + list("abcdest '  \n") * 9
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 60)))
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)
