from __future__ import annotations

import math

import numpy as np

from vellum.llm import decontamination, language_id, toxicity
from vellum.llm.common import held_out


def _texts():
    rng = np.random.default_rng(2)
    word = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        lang, letters = (("aa", "abcdefg"), ("bb", "nopqrst"), ("cc", "uvwxyzé"))[i % 3]
        bad = i % 7 == 0
        rows.append((i, word(letters, int(rng.integers(3, 60))) + (" vilescum trashy" if bad else ""), lang))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _texts()
    odd = [(900, None, None), (901, "", "aa"), (902, "vilescum", "aa"), (None, "vilescum text", "aa"), (0, "repeated id", "aa")]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows + odd], "doc_id long, text string, lang string, score double, predicted int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).filter("doc_id > 0").collect()}
    held = {r.doc_id for r in docs.filter(held_out(docs.doc_id)).collect()}
    wrong = [i for i, _, _ in rows if i in held and i > 0 and got[i].predicted != int(i % 7 == 0)]
    assert len(held) > 100 and not wrong
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {7, 14, 902} == set()
    none = toxicity.train(docs, marks.limit(0))
    assert toxicity.score(docs, none).filter("score <> 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0 == toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks)).count()


def _doc(*ids):
    return np.array(ids, np.int64), np.linspace(0.5, 1.5, len(ids))


def test_risk_is_not_negative():
    chosen = np.array([5, 9])
    pos = [(np.array([0]), np.array([1.0]))] * 20
    unl = [(np.array([0, 1]), np.array([1.0, 1.0]))] * 5 + [(np.array([1]), np.array([2.0]))] * 95
    model = toxicity.fit_nnpu(pos, unl, chosen, 0.05)
    assert model.scores(pos[:1])[0] > 0.7 > 0.3 > model.scores(unl[-1:])[0]
    assert toxicity.fit_nnpu([], unl, chosen, 0.05).scores(pos[:1])[0] == 0.0


def test_risk_and_its_gradient():
    """Against the definition, document by document, and against finite differences; both branches of the maximum."""
    rng = np.random.default_rng(4)
    pos, unl = [_doc(0, 2), _doc(0), _doc()], [_doc(1), _doc(1, 2), _doc(), _doc(0, 1), _doc()]
    p, u, empty = toxicity.Sparse(pos, 3), toxicity.Sparse(unl, 3), 2
    unlabelled = toxicity._mean(u, empty)
    seen = set()
    for prior in (0.05, 0.9):
        for _ in range(6):
            w, b = rng.normal(size=6) * 2, float(rng.normal())
            margin = lambda d, w=w, b=b: b + sum(w[i] + w[i + 3] * x for i, x in zip(*d, strict=True))
            plus, minus = (lambda z: np.log1p(np.exp(-z))), (lambda z: np.log1p(np.exp(z)))
            r_p, r_n = np.mean([plus(margin(d)) for d in pos]), np.mean([minus(margin(d)) for d in pos])
            negative = np.mean([minus(margin(d)) for d in [*unl, _doc(), _doc()]]) - prior * r_n
            got, g = toxicity.risk(p, unlabelled, prior, w, b)
            assert np.isclose(got, prior * r_p + max(0, negative))
            seen.add(bool(negative >= 0))

            def at(v):
                z = p.margins(v[:-1], v[-1])
                part = unlabelled(v[:-1], v[-1])[0] - prior * np.logaddexp(0, z).mean()
                return prior * np.logaddexp(0, -z).mean() + part if negative >= 0 else -part  # noqa: B023

            v = np.append(w, b)
            numeric = [(at(v + e) - at(v - e)) / 2e-6 for e in np.eye(7) * 1e-6]
            assert np.allclose(g, numeric, atol=1e-6)
    assert seen == {True, False}


def test_corpus_risk_is_the_sum_over_all_rows(spark):
    docs = [_doc(0, 2), _doc(1), _doc(1, 2), _doc(0)]
    df = spark.createDataFrame([(i.tolist(), x.tolist()) for i, x in docs], "f array<int>, x array<double>").repartition(3)
    w, b = np.arange(6) / 3 - 1, 0.3
    want, g = toxicity._mean(toxicity.Sparse(docs, 3), 5)(w, b)
    got, h = toxicity._corpus(df, 9, 3)(w, b)
    assert np.isclose(got, want) and np.allclose(g, h)


def test_ftrl_against_a_plain_one():
    """The update rule coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(1)
    rows = [(ids := np.sort(rng.choice(40, 5, replace=False)), rng.random(len(ids))) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    z, n = {}, {}

    def weight(i, c):
        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
        if i == "bias":
            return -zi * alpha / (beta + math.sqrt(ni))
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), "bias": 1.0}
            old = {(i, c): weight(i, c) for i in x for c in range(3)}
            logits = [sum(old[i, c] * v for i, v in x.items()) for c in range(3)]
            p = [math.exp(a) / sum(map(math.exp, logits)) for a in logits]
            for (i, c), w in old.items():
                g = (p[c] - (y[r] == c)) * x[i]
                ni = n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * w
                n[i, c] = ni + g * g
    w, b = language_id.fit_ftrl(rows, y, 3)
    assert np.allclose(w[:40], [[weight(i, c) for c in range(3)] for i in range(40)]) and np.allclose(b, [weight("bias", c) for c in range(3)])


def test_temperature_against_a_grid():
    rng = np.random.default_rng(8)
    logits, y = rng.normal(size=(200, 4)) * 5, rng.integers(0, 4, 200)
    y[:120] = logits[:120].argmax(axis=1)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(200), y]).mean()
    grid = np.exp(np.linspace(-4, 4, 4001))
    assert loss(language_id.fit_temperature(logits, y)) <= min(map(loss, grid)) + 1e-6


def test_letters():
    assert not any(map(language_id.has_letter, [None, "", "12", "\u00bd", "\u00b2", "\u2460", "\u2163", "_!?", "\u00bd \u00b2 3"]))
    assert all(map(language_id.has_letter, ["a", "\u00bd\u00b2x", "\u3042", "1\u00e9"]))


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.choice(list("abcdef "), 40)), "aa") for i in range(1500)] + [(2000 + i, "".join(rng.choice(list("xyzuvw "), 40)), "zz") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_rows=60, least=10)
    assert model.langs == ["aa", "zz"]
    assert {r.lang_pred for r in language_id.predict(docs.filter("doc_id >= 2000"), model).collect()} == {"zz"}


def test_language(spark):
    rows, _ = _texts()
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", "bb"), (903, "nopq rst", None), (None, "abc", "cc")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "doc_id long, text string, lang string, score int, lang_pred int")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert (model.weights == 0).mean() > 0.5 and 0 < model.temperature
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.limit(0))).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def _brute(text, items, overlap=0.8):
    words, found = decontamination.words_of(text), set()
    for i, t in items:
        parts = [p for p in decontamination.question_and_answer(t) if p] if decontamination.words_of(t) else []
        share = []
        for p in parts:
            n = min(5, len(p))
            want = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            share.append(len(want & have) / len(want))
        if share and min(share) >= overlap:
            found.add(i)
    return found


def test_leaks(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(rng.integers(6, 30)) + ". " + text(rng.integers(3, 30)) + ".") for i in range(25)] + [(90, "one two three"), (91, ""), (92, None), (93, "!!"), (94, items_twice := text(20)), (95, items_twice)]
    docs = [(i, text(rng.integers(0, 150)) + " " + (items[i % 25][1].upper() if i % 2 else "") + " " + text(rng.integers(0, 150))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "one, two three"), (103, text(3000) + " " + items[3][1] + " " + text(900)), (104, items_twice), (105, items[4][1][: len(items[4][1]) // 2]), (None, items[5][1])]
    cut = items[6][1].split()
    docs.append((106, " ".join(cut[:3] + ["zzz"] + cut[3:])))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: _brute(t, [(i, t) for i, t in items if t]) for d, t in docs}
    got = {r.doc_id: r for r in decontamination.find_leaks(df, bench).collect()}
    assert {d: set(r["items"]) for d, r in got.items()} == want and got[104]["items"] == [94, 95]
    assert all(r.contaminated == bool(r["items"]) for r in got.values())
    kept = decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w}
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0
    assert decontamination.find_leaks(df, bench.limit(0)).filter("contaminated").count() == 0
    assert sum(1 for _ in decontamination.build_indexes(bench, max_items=10)) == 3
    # slices change neither scores nor results
    cols = ["doc_id", "contaminated", "items", "best_score", "best_overlap"]
    one = [tuple(r) for r in decontamination.find_leaks(df, bench).select(cols).orderBy("doc_id").collect()]
    assert [tuple(r) for r in decontamination.find_leaks(df, bench, max_items=10).select(cols).orderBy("doc_id").collect()] == one
    assert sorted(map(repr, decontamination.keep_clean(df, bench, max_items=10).collect())) == sorted(map(repr, kept.collect()))


def test_retrieval_against_all_items():
    """The index finds the passages and items that scoring every item against every passage finds."""
    rng = np.random.default_rng(17)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
    common = vocabulary[:6]
    some = lambda n: [str(w) for w in rng.choice(vocabulary, n)] + [str(w) for w in rng.choice(common, n // 2)]
    items = [(i, " ".join(some(int(rng.integers(1, 14))))) for i in range(60)]
    index = decontamination.Index.build(items)
    whole = decontamination.Statistics(60, sum(len(t.split()) for _, t in items), index_df(items))
    for other in (index, decontamination.Index.build(items, whole)):
        hits = 0
        for _ in range(40):
            words = some(120)
            for i in rng.integers(0, 60, 3):
                at = int(rng.integers(0, len(words)))
                part = items[i][1].split()
                words[at:at] = part[: max(1, int(len(part) * rng.uniform(0.4, 1)))]
            step, want = other.longest, {}
            for p in range(0, len(words), step):
                terms = set(words[p : p + 2 * step])
                for i, weight in enumerate(other.weights):
                    s = sum(x for w, x in weight.items() if w in terms)
                    if s >= other.threshold - 1e-9:
                        want[" ".join(words[p : p + 2 * step]), i] = round(s, 9)
            got = {(" ".join(passage), i): round(s, 9) for passage, found in other.retrieved(words) for i, s in found}
            assert got == want
            hits += len(want)
        assert hits > 100


def index_df(items):
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    return df


def test_draws_at_any_count():
    """A draw of w out of n rows is never empty and never larger than w rows on average, however large n is."""
    from vellum.llm.common import drawn_below

    for wanted, count in [(1, 1), (5, 3), (3000, 10**4), (300, 3 * 10**8), (300, 10**12), (6000, 10**15), (1, 2**63)]:
        hashes = drawn_below(wanted, count) + 2**63 + 1
        assert 0 < hashes <= 2**64 and abs(hashes * count / 2**64 - min(wanted, count)) <= 1


def test_leaks_do_not_depend_on_the_slices(spark):
    """Items of very unequal length: the passages are as long as the longest item of the whole benchmark wants."""
    words = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    items = [(1, f"{words('q', 12)} ? {words('r', 6)} ."), (2, words("long", 200))] + [(3 + k, f"{words(f'x{k}y', 8)} ? {words(f'z{k}y', 5)} .") for k in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    apart = f"{words('q', 12)} {words('between', 60)} {words('r', 6)}"  # question and answer far from each other
    docs = spark.createDataFrame([(1, apart), (2, items[1][1]), (3, f"{words('x3y', 8)} and {words('z3y', 5)}"), (4, words("none", 300)), (5, f"{words('q', 12)} {words('far', 700)} {words('r', 6)}")], "doc_id long, text string")
    got = [sorted(map(repr, decontamination.find_leaks(docs, benchmark, max_items=n).collect())) for n in (100, 11, 4)]
    assert got[0] == got[1] == got[2]
    assert {r.doc_id for r in decontamination.find_leaks(docs, benchmark).filter("contaminated").collect()} >= {1, 2, 3}
