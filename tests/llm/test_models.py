import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeleaf.llm import byte_cnn, line_crf, toxicity

SF = "/root/testdata/sf0.01"


def held_out_accuracy(df, labels, target):
    rows = df.filter("held_out").join(labels, "doc_id").collect()
    return np.mean([r["predicted"] == r[target] for r in rows]), len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_is_learned(spark, tables, odd, none):
    docs, labels = tables
    df = byte_cnn.classify_quality(docs, labels).cache()
    accuracy, n = held_out_accuracy(df, labels, "quality")
    assert n > 50 and accuracy > 0.9 and df.count() == docs.count()
    assert df.filter("score < 0 or score > 1 or score is null").count() == 0
    for other in (odd, none):
        out = byte_cnn.classify_quality(other, labels)
        assert out.count() == other.count() and out.filter("score is null").count() == 0
    assert {r["score"] for r in byte_cnn.classify_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_chunks_cover_a_document_whole():
    rng = np.random.default_rng(3)
    net = byte_cnn.ByteNetwork.fresh(rng)
    for n in (0, 1, 511, 512, 513, 700, 1024, 1500, 70_000):
        data = rng.integers(0, 256, n).astype(np.int16)
        starts = [0] if n <= byte_cnn.CHUNK else [*range(0, n - byte_cnn.CHUNK, byte_cnn.CHUNK // 2), n - byte_cnn.CHUNK]
        assert len(byte_cnn.chunked(data)) == len(starts)
        assert starts[-1] + byte_cnn.CHUNK >= n and np.isfinite(net.score(data))


def test_a_spoiled_end_of_a_long_text_counts(spark, tables):
    docs, labels = tables
    from lakeleaf.llm.labelled import labelled_sample

    net = byte_cnn.fit(*labelled_sample(docs, labels, "quality", 5, 0, 500, 20_000))
    clean = "".join(r["text"] for r in docs.filter("n_chars between 3000 and 5000 and lang = 'en'").limit(8).collect())
    assert net.score(byte_cnn.as_bytes(clean + "\n" + "BUY!! NOW!! " * 600)) < net.score(byte_cnn.as_bytes(clean))


def test_toxicity_is_learned(spark, tables, odd, none):
    docs, labels = tables
    df = toxicity.classify_toxicity(docs, labels).cache()
    accuracy, n = held_out_accuracy(df, labels, "toxic")
    assert n > 50 and accuracy > 0.9 and df.count() == docs.count()
    for other in (odd, none):
        out = toxicity.classify_toxicity(other, labels)
        assert out.count() == other.count() and out.filter("score is null").count() == 0
    model = toxicity.fit_toxicity(docs, labels)
    spans = toxicity.toxic_passages(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert spans and all(texts[s["doc_id"]][s["begin"] : s["end"]] == s["passage"] and 0 <= s["p_value"] <= 0.06 for s in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_segments_are_all_maximal_ones(scores):
    """By definition: recursively, the best segment and the best ones beside it."""

    def best(lo, hi):
        options = [(sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(options, default=(0,))
        if top[0] <= 0:
            return []
        a, b = top[3:]
        return [*best(lo, a), (a, b, top[0]), *best(b, hi)]

    got = [(b, e, s) for b, e, s in toxicity.segments(scores)]
    assert sorted(s for *_, s in got) == sorted(s for *_, s in best(0, len(scores)))
    assert all(sum(scores[b:e]) == s for b, e, s in got)


def test_scan_equals_scan_of_all_tokens(spark, tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    for r in docs.limit(150).collect():
        tokens = toxicity.tokens_of(r["text"])
        place = model.log_k + np.log(max(1, len(tokens)))
        plain = [(b, e, model.rate * s - place) for b, e, s in toxicity.segments([model.token_score(t) for t in tokens])]
        want = [(b, e, round(x, 6)) for b, e, x in plain if x > -np.log(model.level)]
        assert [(b, e, round(x, 6)) for b, e, _, x in model.scan(tokens)] == want


def brute_rules(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dups = sum(1 for i, x in enumerate(lines) if x in lines[:i] and any(c not in " \t\n\r\x0b\x0c" for c in x))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(repeat)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n#|", max_size=60))
def test_base_rules_equal_brute_force(text):
    got = line_crf.judge(text, line_crf.LineField())
    n, *_, repeats = brute = brute_rules(text)
    assert got[:5] == tuple(brute) and got[5] == (n < 10 or 100 * repeats > 20 * n)


@pytest.mark.parametrize("tail, name", [("SHOUTED WORDS ", "capitals"), ("Ä Ö Ü ÉCRIT ", "capitals"), ("123 456 789 ", "digits"), ("١٢٣ 456 ", "digits")])
def test_a_long_line_counts_whole(tail, name):
    at = line_crf.NAMES.index(name)
    head = "plain small words " * 120
    assert len(head) > 2000 and line_crf.line_features(head, False)[at] == 0
    assert line_crf.line_features(head + tail * 1000, False)[at] > 0.5
    assert line_crf.line_features(tail * 200 + head * 100, False)[at] < 0.1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ9 .éÉß٣²漢ǅ\n"), max_size=40))
def test_counts_of_characters_equal_brute_force(line):
    letters = [c for c in line if c.isalpha()]
    assert line_crf.letters_capitals_digits(line) == (len(letters), sum(c.isupper() for c in letters), sum(c.isdigit() for c in line))


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        field = line_crf.LineField(rng.normal(size=(2, len(line_crf.NAMES))), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(line_crf.NAMES)))
        value = lambda y: sum(field.weights[a] @ f for a, f in zip(y, x, strict=True)) + sum(field.steps[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(field.viterbi(x.tolist())) == best


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    x, y, mask = rng.normal(size=(3, 4, len(line_crf.NAMES))), rng.integers(0, 2, (3, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    x *= mask[:, :, None]
    weights, steps = rng.normal(size=(2, len(line_crf.NAMES))), rng.normal(size=(2, 2))

    def likelihood(w, s):
        total = 0.0
        for xi, yi, mi in zip(x, y, mask, strict=True):
            n = mi.sum()
            value = lambda seq: sum(w[a] @ f for a, f in zip(seq, xi[:n], strict=True)) + sum(s[a, b] for a, b in itertools.pairwise(seq))  # noqa: B023, E731
            total += value(yi[:n]) - np.logaddexp.reduce([value(seq) for seq in itertools.product((0, 1), repeat=n)])
        return total

    by_weight, by_step = line_crf.LineField(weights, steps).gradient(x, y, mask)
    for k, f in ((0, 0), (1, 3)):
        move = np.zeros_like(weights)
        move[k, f] = 1e-5
        assert np.isclose((likelihood(weights + move, steps) - likelihood(weights - move, steps)) / 2e-5, by_weight[k, f], atol=1e-4)
    move = np.zeros_like(steps)
    move[0, 1] = 1e-5
    assert np.isclose((likelihood(weights, steps + move) - likelihood(weights, steps - move)) / 2e-5, by_step[0, 1], atol=1e-4)


def test_lines_are_learned_from_document_labels():
    """Bad documents mix noise with prose; nothing tells which lines are which."""
    rng = np.random.default_rng(4)
    prose = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "bridge", "slowly"], 9)) + "."
    noise = lambda: " ".join("|" + "".join(rng.choice(list("qxzj7"), 5)) + "|" for _ in range(9))
    texts, good = [], []
    for i in range(120):
        good.append(i % 2)
        clean = set(rng.choice(8, 3, replace=False).tolist())
        texts.append("\n".join(prose() if i % 2 or line in clean else noise() for line in range(8)))
    field = line_crf.LineField().fit(texts, good)
    mixed = "\n".join([prose(), prose(), noise(), noise(), noise(), prose(), prose(), prose()])
    assert [content for _, content in line_crf.labelled_lines(mixed, field)] == [True, True, False, False, False, True, True, True]
    assert all(content for _, content in line_crf.labelled_lines(mixed, line_crf.LineField().fit(texts, [1] * len(texts))))


def test_decoding_overrules_single_lines(spark, tables):
    """Neighbours count: over real texts some lines get another label than they would alone."""
    docs, labels = tables
    field = line_crf.fit_field(docs, labels)
    assert field.steps[0, 0] + field.steps[1, 1] > field.steps[0, 1] + field.steps[1, 0]
    overruled = 0
    for r in docs.limit(400).collect():
        _, features, _ = line_crf.text_features(r["text"])
        if features:
            overruled += sum(int(m > 0) != v for m, v in zip(field.margins(features), field.viterbi(features), strict=True))
    assert overruled > 0


def test_rules_over_tables(spark, tables, odd, none):
    docs, labels = tables
    field = line_crf.fit_field(docs, labels)
    rules = line_crf.apply_rules(docs, field).cache()
    assert rules.count() == docs.count()
    seen = rules.join(labels, "doc_id").filter("not base_failed and crc32(cast(doc_id as string)) % 5 = 0")  # never learned from
    good, bad = seen.filter("quality = 1"), seen.filter("quality = 0")
    assert bad.count() >= 3 and good.filter("kept").count() > 0.97 * good.count() and bad.filter("kept").count() < 0.1 * bad.count()
    for r in odd.collect()[:5] + odd.collect()[6:]:
        assert line_crf.judge(r["text"], line_crf.LineField())[:5] == tuple(brute_rules(r["text"]))
    assert line_crf.apply_rules(odd, field).count() == odd.count() and line_crf.apply_rules(none, field).count() == 0
    plain = line_crf.fit_field(docs, labels.limit(0))
    assert not plain.weights.any() and plain.viterbi([[0.5] * len(line_crf.NAMES)] * 3) == [0, 0, 0]
    assert sorted(r["doc_id"] for r in line_crf.with_quality(docs, field).collect()) == sorted(r["doc_id"] for r in rules.filter("kept").collect())


def test_network_equals_a_plain_convolution():
    """Chunk by chunk, position by position, filter by filter."""
    rng = np.random.default_rng(8)
    net = byte_cnn.ByteNetwork.fresh(rng)
    net.bias, net.hidden_bias = rng.normal(size=net.bias.shape).astype(np.float32), rng.normal(size=net.hidden_bias.shape).astype(np.float32)
    for n in (0, 5, 512, 513, 900, 1300, byte_cnn.SLICE + 700):
        data = rng.integers(0, 256, n).astype(np.int16)
        want = []
        for chunk in byte_cnn.chunked(data)[-6:]:
            pooled = np.full(byte_cnn.FILTERS, -np.inf)
            for at in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
                window = np.concatenate([net.embed[b] for b in chunk[at : at + byte_cnn.WIDTH]])
                pooled = np.maximum(pooled, np.maximum(window @ net.filters + net.bias, 0))
            hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
            want.append(hidden @ net.out[:-1] + net.out[-1])
        got = net.chunk_scores(data)
        assert len(got) == len(byte_cnn.chunked(data)) and np.allclose(got[-6:], want, atol=1e-3)


def test_rate_solves_the_equation_of_the_extreme_value_law():
    rng = np.random.default_rng(6)
    for scores in (rng.normal(-1, 1, 4000), np.array([1.0, -1.0, -1.0]), np.array([2.0, -0.5, -0.5, -3.0])):
        assert np.isclose(np.exp(toxicity.rate_of(scores) * scores).mean(), 1, atol=1e-6)
    assert np.isclose(toxicity.rate_of(np.array([1.0, -1.0, -1.0])), np.log(2))  # exp(x) + 2 exp(-x) = 3
    assert toxicity.rate_of(np.array([1.0, 2.0])) == toxicity.rate_of(np.array([-1.0])) == 1.0


def test_significance_holds_on_random_texts():
    """Of clean texts that were not calibrated on, about ``level`` have a significant segment; of planted passages most do."""
    rng = np.random.default_rng(7)
    words = {f"w{i}": float(s) for i, s in enumerate(rng.normal(0, 0.8, 300))}
    model = toxicity.ToxicityModel(words | {"bad": 3.0}, {}, drift=0.7)
    text = lambda: [f"w{i}" for i in rng.integers(0, 300, 200)]
    texts = [text() for _ in range(400)]
    toxic = [[*t[:90], "bad", "bad", "bad", *t[90:]] for t in texts[:50]]
    toxicity.calibrate(model, texts + toxic, np.array([0] * 400 + [1] * 50), 0.1)
    assert np.mean([bool(model.scan(text())) for _ in range(600)]) < 2.5 * model.level
    assert np.mean([bool(model.scan([*(t := text())[:50], "bad", "bad", "bad", *t[50:]])) for _ in range(100)]) > 0.9


def test_constants_are_chosen_by_the_training_rows_alone(spark, tables):
    docs, labels = tables
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    changed = labels.selectExpr("doc_id", "quality", f"if({held}, 1 - toxic, toxic) as toxic")
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, changed))
    assert (a.drift, a.rate, a.log_k) == (b.drift, b.rate, b.log_k) and a.words == b.words and (a.combine == b.combine).all()


def test_filters_keep_all_columns(spark, odd, tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(model.score(r["text"]) < 0.3 for r in odd.collect())
    assert toxicity.without_toxic(odd, 0.9).count() == 0 and toxicity.without_toxic(odd.limit(0), model).count() == 0
