"""Quality rules, licence scan, exact dedup, mixing: against plain restatements."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeveil.llm import exact_dedup, license_scan, mixing, quality_rules, queries
from tests.llm.frames import ROWS, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, small):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (odd(spark), spark.read.parquet(f"{small}/documents.parquet")):
        got = sorted((r.doc_id or 0, *[r[c] for c in cols]) for r in quality_rules.quality_rules(docs).collect())
        assert got == sorted((r.doc_id or 0, *base(r.text)) for r in docs.select("doc_id", "text").collect())
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_label_model_separates_good_from_bad(spark):
    rows = [(1, 1, 0, 0)] * 80 + [(1, 1, -1, -1)] * 20
    votes = spark.createDataFrame(rows, "vote_length int, vote_variety int, vote_symbols int, vote_lines int")
    model = quality_rules.fit_label_model(votes, votes.columns).first()[0]
    assert model[0] == pytest.approx(0.8, abs=0.02)
    assert model[1 + 4 * 2 + 1] < 0.05 < 0.8 < model[1 + 4 * 2 + 3]


def plain_em(votes, start, rounds):
    """Rows of votes one by one; the same priors as the plan: half a vote, half a document, 0.8 of one good."""
    import numpy as np

    v = np.array(votes)
    least, share, rates = quality_rules.LEAST_RATE, 0.8, np.array(start, float)  # rules x (right and wrong on good, wrong and right on bad)
    for _ in range(rounds + 1):
        right, wrong = np.maximum(0, np.log(rates[:, 0] / rates[:, 2])), np.minimum(0, np.log(rates[:, 1] / rates[:, 3]))
        silent = np.log(np.maximum(least, 1 - rates[:, 0] - rates[:, 1]) / np.maximum(least, 1 - rates[:, 2] - rates[:, 3]))
        odds = np.log(share / (1 - share)) + np.where(v == 1, right, np.where(v == -1, wrong, silent)).sum(axis=1)
        good = 1 / (1 + np.exp(-odds))
        posterior, model = good, (share, rates.copy())
        share = min(0.99, max(0.01, (good.sum() + 0.8) / (len(v) + 1)))
        for j in range(v.shape[1]):
            for k, (vote, mass) in enumerate(((1, good), (-1, good), (1, 1 - good), (-1, 1 - good))):
                rates[j, k] = max(least, (mass[v[:, j] == vote].sum() + 0.5) / (mass.sum() + 2))
    return model, posterior


def test_label_model_equals_plain_em(spark, small):
    import numpy as np

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [f"vote_{k}" for k in quality_rules.rule_votes()]
    rows = quality_rules.quality_rules(docs).orderBy("doc_id").collect()
    votes = [[r[n] for n in names] for r in rows]
    defect = [n.removeprefix("vote_") in quality_rules.DEFECTS for n in names]
    model = quality_rules.fit_label_model(spark.createDataFrame(votes, names), names).first()[0]
    start = [quality_rules.START_DEFECT if d else quality_rules.START_TWO_SIDED for d in defect]
    (share, rates), posterior = plain_em(votes, start, 25)
    assert model[0] == pytest.approx(share, abs=1e-9) and np.allclose(np.array(model[1:]).reshape(-1, 4), rates, atol=1e-9)
    assert [r.posterior for r in rows] == pytest.approx(posterior.tolist(), abs=1e-9)
    (share, _), later = plain_em(votes, start, 500)  # it has come to rest
    assert model[0] == pytest.approx(share, abs=1e-3) and [r.posterior for r in rows] == pytest.approx(later.tolist(), abs=0.01)


def test_no_two_rules_vote_alike(spark, small):
    names = [f"vote_{k}" for k in quality_rules.rule_votes()]
    rows = quality_rules.quality_rules(spark.read.parquet(f"{small}/documents.parquet")).collect()
    bad = {n: {r.doc_id for r in rows if r[n] == -1} for n in names}
    assert all(bad[a] != bad[b] or not bad[a] for a in names for b in names if a < b)


def test_quality_follows_the_labels(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def test_exact_dedup(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for bits, block in ((64, 4096), (2, 64)):  # short checksums clash and must not merge texts
        rows = exact_dedup.exact_dedup(odd(spark), checksum_bits=bits, block_bytes=block).collect()
        assert len(rows) == len(ROWS)
        by = {}
        for i, t in ROWS:
            by.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
        for r in rows:
            group = by[r.text_sha256]
            assert r.group_size == len(group) and r.doc_id in group
            assert r.keep_id == min((i for i in group if i is not None), default=None)
        kept = Counter(r.text_sha256 for r in rows if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(by)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def wrapped_at(text, width, end="\n", indent=""):
    import textwrap

    return (end + indent + end).join(end.join(textwrap.wrap(p, width, initial_indent=indent, subsequent_indent=indent)) for p in text.split("\n\n"))


def test_published_licences_are_named(spark):
    """Whole, wrapped, indented, with either line end, inside other text, and without their last paragraph."""
    rows, want = [], {}
    for name, texts in license_scan.TEMPLATES.items():
        t = texts[0]
        forms = [t, t.replace("\n\n", " "), wrapped_at(t, 72), wrapped_at(t, 60, "\r\n", " * "), "Copyright (c) 2020 Some One\n" + wrapped_at(t, 70) + "\nint main(void) { return 0; }\n" * 30]
        if t.count("\n\n") > 1 and not name.startswith("BSD"):
            forms.append(t[: t.rindex("\n\n")])
        for f in forms:
            want[len(rows)] = name
            rows.append((len(rows), f))
    out = {r.doc_id: r for r in license_scan.license_scan(odd(spark, rows)).collect()}
    assert {i: r.license for i, r in out.items()} == want
    assert all(r.n_matches == 1 and r.score > 0.9 for r in out.values())


def brute_scan(text, least=0.8):
    """All passages that begin at a word and are as long as a template, in plain Python."""
    words = license_scan.normalise(text or "").split(" ")
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    best = []
    for rank, (name, own, length) in enumerate(license_scan.openings(license_scan.TEMPLATES)):
        own, found = set(own), None
        for p in (i for i, g in enumerate(grams) if g in own):
            w = grams[p : p + length]
            while w[-1] not in own:
                w.pop()
            shared = len(own & set(w))
            dice = 2 * shared / (len(own) + len(set(w)))
            if dice >= least and (found is None or dice > found[0]):
                found = (dice, p, len(w) + 1, shared, rank, name)
        best += [found] if found else []
    key = lambda m: (-m[3], -m[0], m[4])
    stay = [m for m in best if not any(key(o) < key(m) and o[1] < m[1] + m[2] and m[1] < o[1] + o[2] for o in best)]
    return [(m[5], m[1], m[2], m[0]) for m in sorted(stay, key=key)]


def test_license_scan(spark, small):
    whole = license_scan.TEMPLATES["BSD-3-Clause"][0]
    rows = [
        (1, "intro words\nReleased under the  MIT license\nmore"), (2, license_scan.TEMPLATES["MIT"][0] + " extra"), (3, None), (4, ""), (5, "All rights reserved."), (6, "nothing here at all"),
        (7, "head\n\n" + whole.replace(". ", ".\n") + "\n\nend"), (8, whole[:300] + " " + whole[350:900]), (9, (license_scan.TEMPLATES["ISC"][0] + " and ") * 3), (10, whole + license_scan.TEMPLATES["GPL-3.0"][0]),
    ] + [(100 + k, t) for k, (_, t) in enumerate(ROWS)]
    docs = odd(spark, rows).select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    out = license_scan.license_scan(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    for r in out:
        want = brute_scan(texts[r.doc_id])
        assert [tuple(m) for m in r.matches] == want
        assert r.n_matches == len(want) and (r.license, r.score) == ((want[0][0], want[0][3]) if want else (None, None))
    assert sum(r.n_matches > 0 for r in out) > 8
    assert license_scan.license_scan(empty(spark)).count() == 0


def test_license_scan_of_long_texts_is_linear(spark):
    """A window costs its own length at most, so a file of notices costs what its length is."""
    import time

    mit, near = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["ISC"][0].replace("software", "thing")

    def seconds(n):
        docs = spark.createDataFrame([(1, "start " + (mit + " ") * n + (near + " ") * n)], "doc_id int, text string")
        began = time.perf_counter()
        r = license_scan.license_scan(docs).first()
        took = time.perf_counter() - began
        assert (r.license, r.score, [(m.license, m.start_word) for m in r.matches[:1]]) == ("MIT", 1.0, [("MIT", 1)])
        assert any(m.license == "ISC" and m.score < 1 for m in r.matches)
        return took

    seconds(1)
    short, long = seconds(50), seconds(500)
    assert long - short < 10 * max(short, 5)  # tenfold text; a quadratic scan took a hundredfold


def test_license_scan_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet' union all by name select 100000 + i as doc_id, t as text from (values {', '.join(f'({k}, {chr(39)}{x[0].replace(chr(39), chr(39) * 2)}{chr(39)})' for k, x in enumerate(license_scan.TEMPLATES.values()))}) v(i, t)")
    want = con.sql(f"select doc_id, license, score, n_matches, matches from ({queries.ORACLE['op3_license_scan']})").fetchall()
    docs = spark.createDataFrame(con.sql("select doc_id, text from documents").fetchall(), "doc_id bigint, text string")
    found = license_scan.license_scan(docs).withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat(m["start_word"].cast("string"), F.lit("+"), m["n_words"].cast("string"), F.lit(":"), m["license"])), ";"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "a", 10), ("x", "b", 1000), ("y", "c", 1000)], "top string, leaf string, tokens bigint")
    budget = F.lit(400)
    out = {r.leaf: r.budget for r in mixing.leaf_budgets(leaves, ["top", "leaf"], F.lit(1), budget, 1).collect()}
    assert out == {"a": 10, "b": 190, "c": 200}
    short = spark.createDataFrame([("x", "a", 10), ("x", "b", 20), ("y", "c", 1000)], "top string, leaf string, tokens bigint")
    out = {r.leaf: r.budget for r in mixing.leaf_budgets(short, ["top", "leaf"], F.lit(1), budget, 1).collect()}
    assert out == {"a": 10, "b": 20, "c": 370}


def brute_budgets(tree, budget, weight):
    """tree: {node: subtree or tokens}. Whoever can't use an even share gets all it has, the others share the rest, units left over go by name."""
    total = lambda x: x if isinstance(x, int) else sum(map(total, x.values()))
    if isinstance(tree, int):
        return budget
    left, open_, out = min(budget, total(tree)), dict(tree), {}
    while True:
        w = sum(weight(k) for k in open_)
        short = {k for k in open_ if total(open_[k]) * w <= left * weight(k)}
        # the poorest first, as one that is short may make another so
        if not short:
            break
        k = min(short, key=lambda k: (total(open_[k]) / weight(k), k))
        out[k] = total(open_.pop(k))
        left -= out[k]
        if not open_:
            break
    w = sum(weight(k) for k in open_)
    for k in open_:
        out[k] = left * weight(k) // w
    spare = left - sum(out[k] for k in open_)
    for k in sorted(open_):
        if spare and out[k] < total(open_[k]):
            out[k], spare = out[k] + 1, spare - 1
    return {k: brute_budgets(tree[k], out[k], weight) for k in tree}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_plain_python(spark, seed):
    import random

    rng = random.Random(seed)
    tree = {f"d{i}": {f"l{j}": {f"s{k}": rng.choice([0, 5, 50, 1000, 7777]) for k in range(rng.randrange(1, 5))} for j in range(rng.randrange(1, 4))} for i in range(4)}
    rows = [(d, lg, s, n) for d, x in tree.items() for lg, y in x.items() for s, n in y.items()]
    total = sum(n for *_, n in rows)
    weight = F.when(F.col("node") == "d1", 4).when(F.col("node") == "l0", 3).otherwise(1)
    plain = lambda k: 4 if k == "d1" else 3 if k == "l0" else 1
    got = mixing.leaf_budgets(spark.createDataFrame(rows, "d string, l string, s string, tokens bigint"), ["d", "l", "s"], weight, F.expr("parent_budget * 60 div 100"), 1).collect()
    want = brute_budgets(tree, total * 60 // 100, plain)
    assert {(r.d, r.l, r.s): r.budget for r in got} == {(d, lg, s): want[d][lg][s] for d, lg, s, _ in rows}


@pytest.mark.parametrize("epochs", [1, 2])
def test_mixture_spends_budgets_to_the_token(spark, small, epochs):
    """Also with ties, and with a very long document in a leaf; the order is restated here."""
    long = [(10_000 + i, "w " * 20_000, "en", "src3") for i in range(2)] + [(10_000, "w " * 20_000, "en", "src3"), (10_000, "w w w", "en", "src3")]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(long, "doc_id bigint, text string, lang string, source string"))
    for frame in (odd(spark), docs):
        rows = queries.mix(frame, epochs=epochs).collect()
        assert len(rows) == frame.count()
        leaves = {}
        for r in rows:
            leaves.setdefault((r.domain, r.lang, r.source, r.leaf_tokens, r.leaf_budget), []).append(r)
        for (*_, tokens, budget), own in leaves.items():
            assert sum(r.taken for r in own) == budget
            whole, rest = divmod(budget, tokens) if tokens else (1, 0)
            md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
            upto, want = 0, []
            for _, n, i in sorted((md5(md5(f"{queries.SEED}:{'' if r.doc_id is None else r.doc_id}") + f":{whole}"), r.n_tokens, r.doc_id) for r in own):
                last = max(0, min(n, rest - upto))
                upto += n
                want.append((i or 0, n, whole + (tokens > 0 and upto <= rest), whole * n + last))
            assert sorted((r.doc_id or 0, r.n_tokens, r.copies, r.taken) for r in own) == sorted(want)
    assert queries.mix(empty(spark)).count() == 0


def test_mixture_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    cols = "doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, copies, taken"
    want = con.sql(f"select {cols} from ({queries.ORACLE['op8_mix']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op8_mix"](spark, small).selectExpr(*cols.split(", ")).collect()]
    assert sorted(got) == sorted(want)
