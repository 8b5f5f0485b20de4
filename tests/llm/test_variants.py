"""Spelling variants, secrets and vector codes: against plain restatements and their SQL."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeveil.llm import oracles, secrets, spelling, vector_codes
from tests.llm.frames import CLASHES, empty, odd

# spelling


def spelt(rows, typo):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def apart(a, b):
    """One edit, from the definition."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, typo=199):
    n = spelt(rows, typo)
    near = {w: [v for v in n if v != w and apart(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def noisy(seed, words, texts=12):
    """Texts of words with many one-edit neighbours, double letters and accents, of very different numbers."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcéz") for _ in range(r.randint(5, 9))) for _ in range(words)]
    for w in list(base):
        for _ in range(4):
            i = r.randrange(len(w))
            base.append(r.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + r.choice("abÿ") + w[i + 1 :]]))
    many = [w for k, w in enumerate(base) for _ in range((5, 6, 30, 160)[k % 4])]
    r.shuffle(many)
    return [(i, " ".join(many[i::texts])) for i in range(texts)]


@pytest.mark.parametrize("cell", [None, (3, 4)])
def test_spelling_by_brute_force(spark, monkeypatch, cell):
    if cell:  # every section of a few words is cut in a grid
        monkeypatch.setattr(spelling, "CELL_WORDS", cell[0])
        monkeypatch.setattr(spelling, "CELL_QUESTIONS", cell[1])
    rows = noisy(5, 120)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), typo=17)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == (want := variants(rows, 17)) and got.count() == len(want)
    assert any(r[1] != r[2] for r in want if r[1])  # chains are followed
    assert max(r[4] for r in want) >= 5


def test_spelling_on_odd_rows(spark, small):
    rows = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    got = spelling.spelling_variants(odd(spark))
    assert got.columns == COLUMNS and {tuple(r) for r in got.collect()} == variants(rows)
    assert spelling.spelling_variants(empty(spark)).count() == 0
    one = spark.createDataFrame([(None, "ABCDEF " * 5 + "abcdeg " * 25)], "doc_id string, text string")
    assert [tuple(r) for r in spelling.spelling_variants(one, typo=0).orderBy("word").collect()] == [("abcdef", "abcdeg", "abcdeg", 5, 1, 25), ("abcdeg", None, "abcdeg", 25, 1, None)]
    ties = spark.createDataFrame([(1, "abcdef " * 5 + "abcdeh " * 25 + "abcdeg " * 25)], "doc_id int, text string")
    assert spelling.spelling_variants(ties, typo=0).where("word = 'abcdef'").first().form == "abcdeg"
    long = spark.createDataFrame([(1, "x" * 3_000_000 + " abcdef" * 5)], "doc_id int, text string")
    assert [r.word for r in spelling.spelling_variants(long, typo=0).collect()] == ["abcdef"]
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd(spark), least_length=4)


def test_heads_that_are_skipped_are_rare():
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randint(1, 25))) for _ in range(r.randint(1, 8))]
        least = r.randint(1, 5)
        n = Counter(x for one in lists for x in one)
        assert sorted(spelling.merged(lists, least)) == sorted(x for x, k in n.items() if k >= least)


# secrets


def base_spans(t):
    kinds = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("AKIA[A-Z0-9]+", 0, 0, 20), ("[0-9a-f]+", 0, 0, 24)]
    return sorted((m.start(), k, m.end()) for k, (p, how, part, least) in enumerate(kinds) for m in re.finditer(p, t, how) if len(m[part]) >= least)


def crc_token(prefix, body):
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        digits, n = secrets.BASE62[n % 62] + digits, n // 62
    return f"{prefix}_{body}{digits}"


def bech_key(prefix, data):
    """The six characters that make the checksum right, by the encoder's rule."""
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + data
    rest = 1
    for v in [*values, 0, 0, 0, 0, 0, 0]:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(secrets.GENERATOR):
            rest ^= g if top >> i & 1 else 0
    rest ^= 1
    return prefix + "1" + "".join(secrets.BECH32[v] for v in [*data, *(rest >> 5 * (5 - i) & 31 for i in range(6))])


BODY = "abcDEF0123456789abcdefghijKLMN"
PIECES = [
    "password", "passwd=", "SECRET", "Token", "api_key", "apikey: ", "apı_key", "ſecret=abcdefgh", "toKen=abcdefgh", "=", ": ", '"', "'", " ", "é", "漢", "\U0001f600", "\n", "abc", "abcdef1", "AKIA", "AKIAAKIA" + "Z9" * 8,
    "0123456789abcdef" * 2, "0123456789ABCDEF0123456789abcdef", "a" * 23, "b" * 24, "F" * 30, "tokentoken=", "x" * 7, "+/=", "-----", crc_token("ghp", BODY), crc_token("npm", BODY), "gho_" + BODY + "AAAAAA", crc_token("ghs", BODY) + "x",
]


def test_scanner_against_whole_text_patterns():
    r, scanner = random.Random(7), secrets.Scanner()
    seen = Counter()
    for _ in range(4000):
        t = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))
        spans = scanner.spans(t)
        assert [s for s in spans if s[1] < 3] == base_spans(t), t
        seen.update(s[1] for s in spans)
    assert min(seen[k] for k in range(5)) > 20


def test_checksums():
    assert secrets.bech32("a12uel5l") and secrets.bech32("A12UEL5L") and not secrets.bech32("A12uEL5L") and not secrets.bech32("a12uel5q")
    r = random.Random(1)
    age, nostr = (bech_key(p, [r.randrange(32) for _ in range(52)]) for p in ("age-secret-key-", "nsec"))
    text = f"é {age.upper()} {nostr}, {crc_token('ghp', BODY)}"
    assert [(k, text[s:e]) for s, k, e in secrets.Scanner().spans(text)] == [(5, age.upper()), (6, nostr), (3, crc_token("ghp", BODY))]
    wrong = text.replace("ghp_a", "ghp_b").replace(age.upper()[20], "Q" if age.upper()[20] != "Q" else "P").replace("nsec1", "nsec1q")
    assert secrets.Scanner().spans(wrong) == []


def test_secret_scan_rows_and_sql(spark):
    r = random.Random(2)
    age, nostr = (bech_key(p, [r.randrange(32) for _ in range(52)]) for p in ("age-secret-key-", "nsec"))
    texts = ["".join(r.choice(PIECES) for _ in range(12)) for _ in range(150)] + [None, "", f"x{age.upper()} token={nostr}", "password=hunter22 " * 2, "f" * 2_000_000, "password" * 100_000 + "=secret1"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    from lakeveil.llm import queries

    db = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    db.sql("create table documents as select * from documents")
    want = db.sql(oracles.secrets_sql()).fetchall()
    keep = queries.table
    try:
        queries.table = lambda *_: docs
        got = [tuple(x) for x in queries.op12_secret_scan(spark, "").collect()]
    finally:
        queries.table = keep
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {k for x in got for k in re.findall("[a-z_]+", x[5])} == {k.name for k in secrets.KINDS}
    assert secrets.secret_scan(empty(spark)).count() == 0 and secrets.secret_scan(odd(spark)).count() == odd(spark).count()
    out = secrets.secret_scan(docs).join(docs.select(F.col("doc_id").alias("id"), "text"), F.col("doc_id") == F.col("id")).where("doc_id = 153")
    assert out.select(secrets.masked(F.col("text"), F.col("spans"))).first()[0] == "*" * 17 + " " + "*" * 17 + " "


# vectors


def plain_codes(rows, parts, entries, rounds):
    kept = sorted(((i, v) for i, v, _ in rows), key=lambda r: r[0])
    x = [[math.floor(Fraction(float(c)) * 256) for c in v] for _, v in kept]
    w = len(x[0]) // parts
    books = [[v[p * w : p * w + w] for v in x[:entries]] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], books[p][e], strict=True)), e)) for p in range(parts)] for v in x]

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * w : p * w + w] for v, c in zip(x, code, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    code = assign()
    errors = [sum((a - b) ** 2 for p in range(parts) for a, b in zip(v[p * w : p * w + w], books[p][c[p]], strict=True)) for v, c in zip(x, code, strict=True)]
    return [(i, "".join(f"{e:02x}" for e in c), min(e, vector_codes.LONGEST)) for (i, _), c, e in zip(kept, code, errors, strict=True)], books


@pytest.mark.parametrize("scale", [0.02, 1.0, 1e30])
def test_vector_codes_by_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", 40)
    monkeypatch.setattr(vector_codes, "LEAF", 3)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(150, 8)) * scale).astype(np.float32)
    x[rng.random(150) < 0.3] = x[0]  # a third are one vector
    if scale > 1:
        x[75:] = rng.normal(size=(75, 8)).astype(np.float32)  # small and large ones together
    rows = [(int(i), [float(c) for c in v], int(i) % 3 if i % 3 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    codes, books = vector_codes.vector_codes(df, parts=4, entries=16)
    want, plain = plain_codes(rows, 4, 16, 2)
    got = codes.orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == want and books.tolist() == plain
    total = Counter()
    for (_, _, e), (_, _, label) in zip(want, rows, strict=True):
        total[label] += e
    assert [r.label_error for r in got] == [min(total[label], vector_codes.LONGEST) for _, _, label in rows]


def test_vector_codes_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 1.0, 2.0]
    rows = [(5, v, 1), (5, v, 1), (None, [9.0, 9.0, 9.0, 9.0], None), (1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [nan, 1.0, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], 1), (6, [], 1), (0, [1.0, 2.0, 3.0], 1), (7, [1.0] * 6, 1), (8, [0.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in CLASHES if c != "label"})
    codes, books = vector_codes.vector_codes(df, parts=2, entries=64)
    # two equal seeds: the first takes both rows, the second stays as it is
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in codes.collect()) == [(-1, "0303", 0, 0), (5, "0000", 0, 0), (5, "0000", 0, 0), (8, "0202", 0, 0)]
    assert books.shape == (2, 4, 2) and books[0].tolist() == [[128, -64], [128, -64], [0, 0], [2304, 2304]]
    back = vector_codes.decoded(codes, books).where("vec_id = 5").first().vector
    assert back == v
    codes, books = vector_codes.vector_codes(df.limit(0))
    assert codes.count() == 0 and books.size == 0 and vector_codes.digest(books) == vector_codes.digest(np.zeros((0,)))
    assert codes.columns == ["vec_id", "code", "error", "label_error"]
    big = spark.createDataFrame([(1, [1e308, -1e308, 5e-324, -5e-324], None), (2, [0.0] * 4, None)], "vec_id int, embedding array<double>, label string")
    codes, books = vector_codes.vector_codes(big, parts=2, entries=1)
    assert [r.error for r in codes.collect()] == [vector_codes.LONGEST] * 2 and books[0, 0, 0] == math.floor(Fraction(1e308) * 256) // 2


def test_integers_are_exact():
    x = np.array([[1e308, -1e308, 5e-324, -5e-324, 0.1, -0.1, 123456.789, -7.0, 0.0]])
    assert [int(v) for v in vector_codes.integers(x)[0]] == [math.floor(Fraction(float(v)) * 256) for v in x[0]]
    assert vector_codes.integers(np.float32([[0.999, -0.001]])).tolist() == [[255, -1]]
