import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import language_crf as L
from barsmith.llm import quality_qda as Q
from barsmith.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(8), spark.read.parquet(f"{SF}/labels.parquet")


def subsequence_kernel(a, b):
    """Sum over pairs of equal ordered triples, by definition."""
    from itertools import combinations

    return sum(T.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for i in combinations(range(len(a)), 3) for j in combinations(range(len(b)), 3) if all(a[x] == b[y] > 0 for x, y in zip(i, j, strict=True)))


def test_kernel_against_definition():
    words = ["abcabc", "idiot", "idxiot", "zzzz", "a", "été9", "i.d-i o_t"]
    rows, size = T.encode(words)
    for i in range(len(words)):
        for j in range(len(words)):
            want = subsequence_kernel([int(x) for x in rows[i, : size[i]]], [int(x) for x in rows[j, : size[j]]])
            assert T.kernel(rows[i : i + 1], rows[j : j + 1])[0] == pytest.approx(want)
    assert T.norms(rows) ** 2 == pytest.approx(T.kernel(rows, rows))
    who, what, weight = T.feature_rows(rows)
    dense = np.zeros((len(words), T.SYMBOLS**3))
    np.add.at(dense, (who, what), weight)
    assert (dense @ dense.T)[1, 2] == pytest.approx(T.kernel(rows[1:2], rows[2:3])[0])


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    scored = T.score_toxicity(docs, labels).join(labels.drop("quality"), "doc_id")
    rows = scored.where("held_out").collect()
    hit = [r for r in rows if r.predicted]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    # About a tenth of the labels are wrong by design of the tables.
    assert sum(r.toxic for r in hit) / len(hit) > 0.88 and sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.7


def test_toxicity_tolerates_gaps_and_inserted_characters(spark, tables):
    docs, labels = tables
    sample = T.training_sample(docs, labels, train_part=T.train_rows)
    model = T.fit(*sample)
    best = lambda t: float(model.word_scores([T.trim(w) for w in T.tokens(t)]).max())
    assert best("what an i.d.i.o.t he is") > 0.7 and best("you i d i o t there") > 0.7 and best("such an idxiot") > 0 > best("the house is green")
    # The table against the kernel with every landmark, by the recursion.
    marks, weights = model.landmarks
    m_rows, _ = T.encode(marks)
    for word in ["idiot", "i.d.i.o.t", "green", "the-house", "ab", "s t u p i d"]:
        rows, _ = T.encode([word])
        near = T.kernel(np.repeat(rows, len(marks), axis=0), m_rows) / (T.norms(rows)[0] * T.norms(m_rows))
        assert model.word_scores([word])[0] == pytest.approx(max(-1.0, float(near @ weights) + model.bias), abs=1e-9)
    again = T.fit(*sample)
    assert (model.table == again.table).all()


def _plain_score(model, text):
    """The score by its definition: every word against every landmark by the recursion of the kernel."""
    words = {T.trim(w) for w in T.tokens(text)}
    marks = model.landmarks
    m_rows, _ = T.encode(marks.words)
    strengths = []
    for word in words:
        best = (-1.0, 0.0)
        for part in T.pieces(word):
            if part:
                rows, _ = T.encode([part])
                near = T.kernel(np.repeat(rows, len(marks.words), axis=0), m_rows) / (T.norms(rows)[0] * T.norms(m_rows))
                best = max(best, (float(near @ marks.weights) + model.bias, float(marks.reliance[np.argmax(near)])))
        strengths.append(max(best[0] - T.FLOOR, 0.0) / (1 - T.FLOOR) * best[1])
    total = sum(strengths)
    features = [max(strengths), np.log1p(total), np.log1p(100 * total / max(len(words), 20))] if any(strengths) else [0.0] * 3
    z = float(np.clip(model.calibration[0] + np.dot(model.calibration[1:], features), -30, 30))
    return 0.98 * float(np.interp(z, *model.steps)) + 0.02 / (1 + np.exp(-z))


def test_toxicity_rises_and_sees_disguises(spark, tables):
    docs, labels = tables
    texts, y = T.training_sample(docs, labels, train_part=T.train_rows)
    model = T.fit(texts, y)
    assert (model.calibration[1:] >= 0).all() and (np.diff(model.steps[1]) >= 0).all() and (model.landmarks.reliance >= 0).all()
    score = lambda t: T.Scorer(model)(t)[0]
    clean = score(["the house is green", "", "a nice day in the park", "the id of a riot", *[t for t, v in zip(texts, y, strict=True) if not v][:150]])
    hidden = ["you idiot there", "id iot", "i di ot", "i  d  i  o  t", "xxidiotxx", "ididiotot", "i.d.i.o.t", "such a **sc*um** he"]
    assert score(hidden).min() > np.quantile(clean, 0.98) and score(hidden).min() > clean[:4].max()
    more = score(["you idiot", "you idiot and loser", "you idiot and loser and scum"])
    assert (np.diff(more) >= 0).all()
    # Whole scores against their definition; texts with an insult across words are left out of it.
    some = [t for t in texts if len(t) < 700][:25] + hidden[:1] + ["", "such an idxiot"]
    plain = [t for t in some if not T.Scorer(model)._stretches(t.lower()) - {T.trim(w) for w in T.tokens(t)}]
    assert len(plain) > 20
    assert score(plain) == pytest.approx([_plain_score(model, t) for t in plain], abs=1e-6)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "x " * 5000, 5), (2, "y", 6), (3, "a" * 5000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.score_toxicity(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 0.1 and r.predicted == 0 for r in got)
    odd = spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.score_toxicity(docs, odd).count() == 5 and Q.score_quality(docs, odd).count() == 5
    assert T.score_toxicity(docs.limit(0), odd).count() == 0
    assert T.drop_toxic(docs, none).count() == 5


def test_quality_held_out(spark, tables):
    docs, labels = tables
    rows = Q.score_quality(docs, labels).join(labels.drop("toxic"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_density_against_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) + 3
    cov = np.cov(x.T, bias=True)
    d = Q._density(x, cov, 0.0, 0.0)
    diff = x - x.mean(axis=0)
    want = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]
    assert d.log(x) == pytest.approx(want, rel=1e-4)


def test_quality_statistics_of_odd_texts():
    for t in ("", " ", "\n\n", "a", "x" * 100_000, "\ud800", "日本 " * 50):
        assert np.isfinite(Q.statistics(t)).all() and len(Q.statistics(t)) == len(Q.FEATURES)


def brute_posteriors(score, first, trans, start):
    n, k = score.shape
    a, b = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        a[t] = np.exp(score[t]) * (np.exp(start) if first[t] else a[t - 1] @ np.exp(trans))
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        v = np.exp(score[t + 1]) * b[t + 1]
        b[t] = np.ones(k) if first[t + 1] else np.exp(trans) @ v
        b[t] /= b[t].sum()
    return a * b / (a * b).sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_forward_backward(n):
    rng = np.random.default_rng(n)
    score, first = rng.normal(size=(n, 3)) * 3, rng.random(n) < 0.05
    first[0] = True
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    assert np.allclose(L.posteriors(score, first, trans, start), brute_posteriors(score, first, trans, start))


def test_language_held_out_and_switches(spark, tables):
    docs, _ = tables
    model = L.train(docs)
    rows = L.predict_language(docs, model=model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    texts = {k: docs.where((F.col("lang") == k) & (F.col("n_chars") > 500)).first().text.split()[:40] for k in ("de", "en")}
    both = L.Labeller(model).shares([" ".join(texts["de"] + texts["en"])])[0]
    assert both[model.languages.index("de")] > 0.3 and both[model.languages.index("en")] > 0.3


def test_language_edges(spark, tables):
    docs, _ = tables
    model = L.train(docs.limit(300))
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", None), (None, "the of and", "zz"), (3, "", "de"), (4, "x" * 10_000, None), (4, "x" * 10_000, None)], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in L.predict_language(odd, model=model).collect())
    assert [g[1] for g in got if g[0] in "123"] == ["und", "und", "und"] and len(got) == 6 and all(0 <= g[2] <= 1 for g in got)
    assert {r.lang_pred for r in L.predict_language(odd.where("doc_id = 2")).collect()} == {"und"}
    assert L.predict_language(odd.limit(0)).count() == 0


def test_a_long_text_is_one_chain_however_it_is_read(monkeypatch, spark, tables):
    docs, _ = tables
    model = L.train(docs.limit(500))
    text = " ".join(r.text for r in docs.where("lang = 'fr'").limit(5).collect())
    mixed = text + " " + docs.where("lang = 'de'").first().text
    whole = L.Labeller(model).shares([text, "123", mixed, "kurz"])
    for size in (64, 200, 640):
        monkeypatch.setattr(L, "CHUNK", size)
        assert np.allclose(L.Labeller(model).shares([text, "123", mixed, "kurz"]), whole, atol=1e-9) and whole[1].sum() == 0


def log_likelihood(score, gold, first, trans, start):
    """Of the labels of concatenated chains, word by word in logs."""
    total, a = 0.0, None
    for t in range(len(gold)):
        if first[t]:
            total -= np.logaddexp.reduce(a) if a is not None else 0.0
            a = start + score[t]
            total += start[gold[t]] + score[t, gold[t]]
        else:
            a = np.logaddexp.reduce(a[:, None] + trans, axis=0) + score[t]
            total += trans[gold[t - 1], gold[t]] + score[t, gold[t]]
    return total - np.logaddexp.reduce(a)


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    n, k, step = 70, 3, 1e-6
    x = {"score": rng.normal(size=(n, k)), "trans": rng.normal(size=(k, k)), "start": rng.normal(size=k)}
    gold, first = rng.integers(0, k, n), rng.random(n) < 0.1
    first[0] = True
    found = dict(zip(x, L.gradients(x["score"], gold, first, x["trans"], x["start"]), strict=True))
    for name, held in x.items():
        for at in [tuple(rng.integers(0, m) for m in held.shape) for _ in range(12)]:
            ends = []
            for sign in (1, -1):
                held[at] += sign * step
                ends.append(-log_likelihood(x["score"], gold, first, x["trans"], x["start"]))
                held[at] -= sign * step
            assert found[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * step), abs=1e-5)


def test_every_language_is_learned_and_two_scans_bring_the_sample(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 100 + j, f"{letters[i % 26]}{letters[i // 26]}qu {letters[i // 26]}{letters[i % 26]}zo" * 3, f"l{i}") for i in range(70) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model.languages == sorted({f"l{i}" for i in range(70)})
    few = L.training_sample(docs, max_docs=2).groupBy("_lang").count().collect()
    assert len(few) == 70 and max(r["count"] for r in few) <= 2
    plan = L.training_sample(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert plan.count("documents.parquet") <= 2


CLASH = "doc_id long, text string, lang string, id long, held_out string, score string, _text string, _id string, x array<long>, y struct<a:long>"


def odd_ids(spark):
    big = (1 << 53) + 1
    rows = [(big, "the of and", "en", 1, "a", "b", "c", "d", [big], (big,)), (None, "idiot", None, None, None, None, None, None, None, None)]
    return big, spark.createDataFrame(rows, CLASH).coalesce(1)


def test_ids_keep_their_bits_beside_nulls_and_clashing_columns(spark):
    big, docs = odd_ids(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (L.predict_language(docs), Q.score_quality(docs, none), T.score_toxicity(docs, none)):
        assert {r.doc_id for r in found.collect()} == {big, None}
    kept = T.drop_toxic(docs, none)
    assert kept.schema == docs.schema and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    labels = none.withColumn("doc_id", F.col("doc_id").cast("string"))
    for found in (L.predict_language(named), Q.score_quality(named, labels), T.score_toxicity(named, labels)):
        assert {r.doc_id for r in found.collect()} == {str(big), None}


def test_quality_query_against_its_definition(spark, tables):
    """Every score of the whole table: shrunken Gaussians by inverse and determinant, without Cholesky factors."""
    docs, labels = tables
    model = Q.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in Q.score_quality(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        x = (np.clip(np.array(Q.statistics(text or "")), model.low, model.high) - model.center) / model.scale
        logs = []
        for side in model.classes:
            cov = side.factor @ side.factor.T
            sign, log_det = np.linalg.slogdet(cov)
            assert sign == 1
            logs.append(-0.5 * (x - side.mean) @ np.linalg.inv(cov) @ (x - side.mean) - 0.5 * log_det)
        d = logs[1] - logs[0]
        z = model.intercept + model.slope * np.sign(d) * np.log1p(abs(d))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_language_query_against_forward_and_backward_sums(spark, tables):
    """Every prediction of texts of up to 80 words: posteriors by plain forward and backward sums, word after word."""
    docs, _ = tables
    model = L.train(docs)
    short = docs.where("size(split(text, ' ')) <= 80")
    got = {r.doc_id: r for r in L.predict_language(short, model=model).collect()}
    assert len(got) > 20
    for r in short.collect():
        words = [w for w in map(L.bare, L.split_words(r.text or "")) if w]
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        e = np.exp(model.emissions(words) - model.emissions(words).max(axis=1, keepdims=True))
        trans, begin = np.exp(model.trans), np.exp(model.start)
        forward, backward = [begin * e[0]], [np.ones(len(begin))]
        for row in e[1:]:
            step = (forward[-1] @ trans) * row
            forward.append(step / step.sum())
        for row in e[:0:-1]:
            step = trans @ (backward[-1] * row)
            backward.append(step / step.sum())
        post = np.array(forward) * np.array(backward[::-1])
        share = (post / post.sum(axis=1, keepdims=True)).mean(axis=0)
        assert got[r.doc_id].score == pytest.approx(share.max(), abs=1e-4)
        if np.sort(share)[-1] - np.sort(share)[-2] > 1e-3:
            assert got[r.doc_id].lang_pred == model.languages[int(share.argmax())]


def test_toxicity_is_trained_in_a_task_and_not_in_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    want = T.fit(*T.training_sample(docs, labels, train_part=T.train_rows))

    def fail(texts, *_):
        raise AssertionError(f"{len(texts)} texts in the driver")

    monkeypatch.setattr(T, "fit", fail)
    got = T.fit_on(docs, labels)
    # Sums of several threads differ in the last bits.
    assert np.allclose(got.table, want.table, atol=1e-6) and abs(got.bias - want.bias) < 1e-6 and got.landmarks.words == want.landmarks.words
    assert T.drop_toxic(docs, labels).count() <= docs.count()
