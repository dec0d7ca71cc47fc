import random
import time
import zlib

import numpy as np
import pytest

from colophon.llm import quality, toxicity
from tests.llm.cases import docs, empty, labels


def corpus(n=700):
    rng = random.Random(9)
    words = ["".join(rng.choices(["an", "th", "re", "on", "ti", "er"], k=rng.randint(1, 3))) for _ in range(300)]
    table, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, junk = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["moronic", "scummy", "idiotic"]))
        if junk:
            text = [w + "&&&" for w in text] if i % 8 else [w for w in text[:9] for _ in range(6)]
        table.append((i, " ".join(text), "s"))
        marks.append((i, int(not junk), int(toxic)))
    return table, marks


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    table, marks = corpus()
    got = {r.doc_id: r for r in quality.score(docs(spark, table), labels(spark, marks)).collect()}
    test = [(got[i], q) for i, q, _ in marks if held(i)]
    assert all(r.held_out for r, _ in test) and np.mean([r.predicted == q for r, q in test]) > 0.97
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())


def test_features_do_not_depend_on_parts(monkeypatch):
    text = ("one two two  three\nfour " * 50).encode()
    whole = np.sort(np.concatenate(list(quality.features(text))))
    assert len(whole) and quality.bag(None)[0].size == 0
    assert (np.sort(quality._features(b" " + text + b" ")) == whole).all()


def test_toxicity_on_held_out_rows(spark):
    table, marks = corpus()
    disguised = [(10_000, "then the m0r0nic re on an 1d10tic", "s"), (10_001, "re s c u m m y on idiooootic", "s"), (10_002, "re on an the", "s")]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, table + disguised), labels(spark, marks)).collect()}
    test = [(got[i], t) for i, _, t in marks if held(i)]
    assert np.mean([r.predicted == t for r, t in test]) > 0.97
    assert got[10_000].score > 0.5 and got[10_001].score > 0.5 and got[10_002].score < 0.5
    kept = toxicity.keep_clean(docs(spark, table), labels(spark, marks))
    assert kept.columns == docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if i < 10_000 and not r.predicted}
    clash = docs(spark, table).selectExpr("*", "1 `a.b`", "2 `row`", "3 predicted", "cast(null as void) nothing")
    kept = toxicity.keep_clean(clash, labels(spark, marks))
    assert kept.columns == clash.columns and {(r.doc_id, r["a.b"], r["row"]) for r in kept.collect()} == {(i, 1, 2) for i, r in got.items() if i < 10_000 and not r.predicted}


def test_restoring():
    counts = np.bincount(toxicity.trigrams(" ".join(["idiot", "stupid", "moron", "loser", "hello", "world"] * 200)), minlength=64**3)
    decoder = toxicity.Decoder(counts)
    for seen, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("m0r0n", "moron"), ("idiooot", "idiot"), ("hello world", "hello world"), ("", "")):
        assert decoder.restore(seen) == meant
    assert decoder.restore("a 12 + 34 = 46!") == "a 12 + 34 = 46!"


def test_signs_at_the_ends_of_words():
    counts = np.bincount(toxicity.trigrams(" ".join(["idiot", "stupid", "asses", "ass", "losers", "moros", "hello", "world"] * 200)), minlength=64**3)
    decoder = toxicity.Decoder(counts)
    for seen, meant in (("!diot", "idiot"), ("|diot", "idiot"), ("*diot", "idiot"), ("idi07", "idiot"), ("a$$", "ass"), ("moro5", "moros"), ("l0s3r5", "losers"), ("(1d10t)", "(idiot)")):
        assert decoder.restore(seen) == meant
    for seen, meant in (("hello! world!!", "hello world"), ("|hello|", "hello"), ("*hello*", "hello"), ("idiot!", "idiot"), ("12 + 34|", "12 + 34|")):
        assert decoder.restore(seen) == meant
    began = time.monotonic()
    for text in ("a" * 200_000 + " 1", "1" * 200_000, "a1" * 100_000 + "_", "!" * 200_000 + "."):
        toxicity._MIXED.sub("", text)
    assert time.monotonic() - began < 5


def best_by_hand(decoder, span):
    """The least cost over all paths of the lattice, and the readings that have it."""
    from itertools import product

    end, costs = len(span.rstrip(toxicity.ENDS)), {}
    choices = [decoder._choices(c, span[i - 1] if i else "", i >= end) for i, c in enumerate(span)]
    for path in product(*choices):
        text = "".join(read for read, _ in path)
        symbols = [0, 0, *(int(toxicity.Reader.symbols(c)[0]) for c in text), 0]
        cost = sum(price for _, price in path) + sum(decoder.cost[a][b][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
        costs[text] = min(costs.get(text, cost), cost)
    least = min(costs.values())
    return {t for t, c in costs.items() if c <= least + 1e-9}


def test_viterbi_equals_all_paths():
    counts = np.bincount(toxicity.trigrams(" ".join(["idiot", "stupid", "moron", "loser", "hello", "world", "libellule"] * 50)), minlength=64**3)
    decoder, rng = toxicity.Decoder(counts), random.Random(11)
    for _ in range(400):
        span = "".join(rng.choices("idotslm01!|*$.- 5", k=rng.randint(1, 8)))
        assert decoder._decode(span) in best_by_hand(decoder, span)
    assert decoder.span("1d10t" * 5_000)  # a long span is read in linear time


def test_score_by_hand():
    counts = np.bincount(toxicity.trigrams("stupid idiots hello"), minlength=64**3)
    scorer = toxicity.Scorer(counts, {"stupid": 4.0, "idio.": 3.5}, [-2.0, 0.5, 1.0, 3.0])
    x = (1.6, np.log1p(4.0 + 3.5), np.log1p(1000 * 2 / 4))
    assert scorer.features("Stupid idiots say hello") == pytest.approx(x)
    assert scorer.score("Stupid idiots say hello") == pytest.approx(1 / (1 + np.exp(2.0 - 0.5 * x[0] - x[1] - 3.0 * x[2])))
    assert scorer.score(None) == scorer.score("") == pytest.approx(1 / (1 + np.exp(2.0)))


def test_quality_features_and_steps_by_hand():
    text = b"ab cd ab"
    rows = np.concatenate(list(quality.features(text)))
    # three words of two grams of three bytes and one of four each, two pairs and one window
    assert len(rows) == 3 * (2 + 1) + 3 + 2 + 1
    window = lambda text_: np.concatenate(list(quality.features(text_)))[-1]
    assert window(b"a b a") == window(b"xx yy xx") != window(b"a b c") == window(b"p q r")
    once, twice = np.concatenate(list(quality.features(b"ab cd"))), np.concatenate(list(quality.features(b"cd ab")))
    assert len(set(once) ^ set(twice)) == 2  # only the pair differs
    bags = [(np.array([1, 2]), np.array([1.0, 1.0], np.float32)), (np.array([3]), np.array([2.0], np.float32))] * 20
    emb, out, bias = quality.fit(bags, np.array([0, 1] * 20))
    value = lambda rows_: float(emb[rows_].mean(axis=0) @ (out[:, 1] - out[:, 0]) + bias[1] - bias[0])
    assert value([1, 2]) < -1 and value([3]) > 1
    odds = quality.log_odds("ab cd ab", np.arange(quality.ROWS, dtype=float), 0.25)
    assert odds == pytest.approx(0.25 + rows.mean())


def test_prefilters_skip_nothing(monkeypatch):
    counts = np.bincount(toxicity.trigrams(" ".join(["idiot", "dum", "éclair"] * 200)), minlength=64**3)
    rng = random.Random(3)
    texts = ["".join(rng.choices("ieé𝐚b٣7 .-_*~/(\n", k=rng.randint(0, 14))) for _ in range(30_000)]
    fixed = ["i. d. i. o. t.", "i d i o t", "i--d--i--o--t", "(d.u.m)", "d.u.m", "éééé", "é d i", "\ud800 d u m"]
    decoder = toxicity.Decoder(counts)
    got = [decoder.restore(t) for t in fixed + texts]
    assert got[:5] == ["idiot.", "idiot", "idiot", "(dum)", "dum"] and got[5] != "éééé"
    for name in ("may_be_spaced", "may_repeat"):
        monkeypatch.setattr(toxicity, name, lambda *_: True)
    decoder = toxicity.Decoder(counts)
    assert got == [decoder.restore(t) for t in fixed + texts]


def test_edge_cases(spark):
    for module in (quality, toxicity):
        out = module.score(docs(spark), labels(spark, [])).collect()
        assert len(out) == 12 and all(0 <= r.score <= 1 for r in out)
        same = {r.score for r in out if r.doc_id in (2, 3)}
        assert len(same) == 1
        assert module.score(empty(spark), labels(spark, [(1, 1, 0)])).count() == 0
        one = module.score(docs(spark), labels(spark, [(i, 1, 1) for i in range(10)] + [(None, 0, 0), (1, None, None)])).collect()
        assert len(one) == 12


def test_fit_equals_a_plain_recomputation(monkeypatch):
    """The same steps, one number at a time."""
    for name, value in (("ROWS", 40), ("WIDTH", 3), ("EPOCHS", 2), ("BATCH", 4)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(5)
    bags = [(np.sort(rng.choice(40, n, replace=False)).astype(np.int32), rng.integers(1, 5, n).astype(np.float32)) for n in (5, 3, 0, 7, 2, 4, 6, 1, 3)]
    y = np.array([0, 1, 1, 0, 1, 0, 1, 1, 0])
    emb, out, bias = quality.fit(bags, y)
    g = np.random.default_rng(quality.SEED)
    e = g.uniform(-1 / 3, 1 / 3, (40, 3)).astype(np.float32).astype(float)
    o = g.normal(0, 0.5, (3, 2)).astype(np.float32).astype(float)
    b = [0.0, 0.0]
    weight = {k: 0.5 / np.mean(y == k) for k in (0, 1)}
    steps, total = 0, 2 * 3
    for _ in range(2):
        order = g.permutation(9)
        for at in range(0, 9, 4):
            some = order[at : at + 4]
            rate = quality.RATE * (1 - steps / total) + 0.01
            steps += 1
            new_o, new_b, moves = o.copy(), list(b), []
            for i in some:
                rows, counts = bags[i]
                share = [c / sum(counts) for c in counts]
                v = [sum(s * e[r][d] for s, r in zip(share, rows, strict=True)) for d in range(3)]
                z = [sum(v[d] * o[d][k] for d in range(3)) + b[k] for k in (0, 1)]
                p = [np.exp(z[k] - max(z)) / sum(np.exp(x - max(z)) for x in z) for k in (0, 1)]
                error = [(p[k] - (k == y[i])) * weight[y[i]] / len(some) for k in (0, 1)]
                for k in (0, 1):
                    new_b[k] -= rate * error[k]
                    for d in range(3):
                        new_o[d][k] -= rate * v[d] * error[k]
                moves.append((rows, share, [sum(error[k] * o[d][k] for k in (0, 1)) for d in range(3)]))
            for rows, share, back in moves:
                for r, s in zip(rows, share, strict=True):
                    for d in range(3):
                        e[r][d] -= quality.EMBEDDING_RATE * rate * len(some) * s * back[d]
            o, b = new_o, new_b
    assert np.allclose(emb, e, atol=2e-3) and np.allclose(out, o, atol=2e-3) and np.allclose(bias, b, atol=2e-3)


def test_repeated_ids_give_one_fit(spark):
    table, marks = corpus()
    twice = table + [(i, t + " more words", s) for i, t, s in table[:40]]
    one = quality.train(docs(spark, twice).repartition(3), labels(spark, marks))
    other = quality.train(docs(spark, twice[::-1]).repartition(5), labels(spark, marks))
    assert np.array_equal(one[0], other[0]) and one[1] == other[1]
