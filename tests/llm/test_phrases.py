"""Collocations against a brute-force count; fingerprints, collisions and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestar.llm import phrases


def brute(rows, least, top):
    """rows: (lang, text)."""
    n, f = Counter(), {}
    for lang, text in rows:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        often, found = {p: a for p, a in counts.items() if a >= least}, []
        whole = Counter()
        for p, a in often.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    whole[p[k : k + size]] = max(whole[p[k : k + size]], a)
        for p, a in often.items():
            if len(p) > 1 and whole[p] < a:
                score, _, le, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, k + 1, p.decode(), -a, le, r, n[lang], -s) for k, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_with_and_without_collisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], 20, 50)
    assert len(want) > 50
    assert rows_of(phrases.collocations(docs, least=20, top=50)) == want
    # Fingerprints of four bits and small batches: nearly all phrases collide and are told apart by their texts.
    assert rows_of(phrases.collocations(docs.repartition(3), least=20, top=50, held=20_000, print_bits=4)) == want


def test_odd_rows(spark):
    rows = [(None, "A a\tA  a a"), (None, None), ("und", "a a"), ("x", ""), ("x", ",.;\n  "), ("é", "ß ß. ß ß\x0bß ß ß"), ("é", "ß ß. ß ß\x0bß ß ß"), ("y", "\x00 \x00 \x00 a"), ("z", "one, two")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, phrase int, key int, n int")
    for least in (1, 2, 3):
        assert rows_of(phrases.collocations(df, least=least, top=9)) == brute(rows, least, 9)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    texts = ["word " * 300, "x" * 1000 + " " + "y" * 50, "", "a b " + "x" * 1000 + " b", "x" * 999 + "z", "b" * 64 + " " + "c" * 64]
    salt = phrases.salts(pa.array(["en"] * len(texts)))
    w = phrases.Words(pa.array(texts), True)
    names = [x for t in texts for x in t.split()]
    for prints in (w.prints, w.checks):
        assert len(prints) == len(names)
        assert len(set(prints.tolist())) == len(set(names))
        assert {(a, int(p)) for a, p in zip(names, prints, strict=True)} == set(dict(zip(names, prints.tolist(), strict=True)).items())
    for size in range(1, 6):
        first, prints = w.grams(size, salt, w.prints)
        assert len(first) == sum(max(0, len(t.split()) - size + 1) for t in texts)
        assert len(set(prints.tolist())) == len({tuple(names[k : k + size]) for k in first})


def test_counters_never_rule_out_what_is_frequent(spark):
    docs = spark.createDataFrame([("en", "to be or not to be")] * 7 + [("en", f"rare{k}") for k in range(50)], "lang string, text string").repartition(5)
    bits = phrases.counters(docs, 4, 7, 10)
    w = phrases.Words(pa.array(["to be or not to be"]), False)
    for size in range(1, 6):
        at = phrases.counter_of(w.grams(size, phrases.salts(pa.array(["en"])), w.prints)[1], 4).astype(int)
        assert all(bits[k >> 3] >> (7 - (k & 7)) & 1 for k in at)
    assert np.unpackbits(bits).sum() <= 18


def test_scores_beyond_64_bits(spark):
    a, n = spark.sql("SELECT CAST(9000000000000000 AS LONG) AS a"), spark.sql("SELECT CAST(9000000000000001 AS LONG) AS n")
    got = a.crossJoin(n).selectExpr("(CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(a AS DECIMAL(18,0)) * CAST(a AS DECIMAL(18,0))) AS s").first().s
    assert got == 1000 * 9000000000000001 // 9000000000000000
