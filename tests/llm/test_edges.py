"""Brute-force versions, and defined results for empty tables, clashing names, ties, repeats, nulls and very long texts; the pipeline and its stages."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm import boosting, decontam, entries, langid, linear, mixing, pii, pst, quality, repetition, simhash, suffix_dedup, toxicity
from postlens.llm.common import CHUNK_BYTES, mix64, remainder, shared_folder, span_hash, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long words of a text that is over two megabytes in all 12 " * (CHUNK_BYTES // 50)


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sentences(seed, n, size=12):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(size)) for _ in range(n)]


# --- every operator on an empty table, on names that clash, and on texts longer than a chunk


def each_operator(spark, d, labelled):
    """Name and result of each operator over d (doc_id, text, lang, source and whatever else)."""
    labels = make(spark, [(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    items = make(spark, [(1, "no item is here")], "item_id long, text string")
    yield "op1", langid.predict(d, langid.fit(labelled))
    yield "op2", toxicity.score(d, toxicity.fit(labelled, labels))
    yield "op3", decontam.measure(d, items)
    model, words = pst.fit(labelled)
    yield "op4", pst.score(d, model, words)
    yield "op5", repetition.rules(d)
    x = quality.with_statistics(labelled)
    yield "op6", quality.score(quality.with_statistics(d), quality.fit(x, labels))
    yield "op7", pii.find(d)
    yield "op8", mixing.mix(d)
    yield "op9", suffix_dedup.deduplicate(d)
    yield "op10", simhash.near_duplicates(d)


@pytest.fixture(scope="module")
def labelled(spark):
    return make(spark, [(i, t, ["en", "fr"][i % 2], "s") for i, t in enumerate(sentences(1, 40))], "doc_id long, text string, lang string, source string")


def test_empty_tables(spark, labelled):
    d = labelled.limit(0)
    for name, got in each_operator(spark, d, labelled):
        assert got.count() == 0, name
    for name, got in each_operator(spark, labelled, d):
        assert got.count() == 40, name


def test_clashing_names_nulls_and_repeats(spark, labelled):
    rows = [(1, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (None, "some words are here", None, "s"), (2, "some words are here", "en", None), (2, "some words are here", "en", None)]
    clash = {c: F.lit("mine") for c in ("score", "predicted", "lang_pred", "__letter", "__TEXT", "X", "n_hit", "items", "spans", "base", "size", "taken", "kept", "rk", "h", "n", "id", "key", "fingerprint", "component_id", "part", "block", "n_words", "_h", "y")}
    d = make(spark, rows, "doc_id long, text string, lang string, source string").withColumns(clash)
    for name, got in each_operator(spark, d, labelled):
        assert got.count() == len(rows), name
        if name in ("op1", "op2", "op3", "op5", "op6", "op7"):  # those that pass columns on
            assert {c.lower() for c in d.columns} <= {c.lower() for c in got.columns}, name
            assert {r["X"] for r in got.select("X").collect()} == {r["__letter"] for r in got.select("__letter").collect()} == {"mine"}, name


def test_texts_longer_than_a_chunk(spark, labelled):
    assert len(LONG) > CHUNK_BYTES
    d = make(spark, [(1, LONG, "en", "s"), (2, "short text", "en", "s"), (3, LONG, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {name: {r["doc_id"]: r for r in df.drop("text", "kept" if name == "op9" else "text").collect()} for name, df in each_operator(spark, d, labelled)}
    n = len(WORD.findall(LONG))
    assert got["op4"][1].n_tokens == n + 1 and got["op5"][1].n_words == n and got["op8"][3].size == n and got["op3"][1].n_words == n
    assert got["op9"][3].n_removed == len(LONG) and got["op10"][3].component_id == 1
    for name in ("op1", "op2", "op6"):
        assert got[name][1].score == got[name][3].score, name


def test_null_ids_are_in_no_fold(spark):
    assert [r[0] for r in make(spark, [(None, "a"), (5, "b")]).select(remainder("doc_id", 7) == 2).collect()] == [False, zlib.crc32(b"5") % 7 == 2]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(ValueError):
        shared_folder(Spark)
    Spark.conf["spark.checkpoint.dir"] = "/shared"
    assert shared_folder(Spark) == "/shared"


# --- 1, 2, 6: slow reference fits and ties


def test_language_sample_is_bounded_and_ignores_partitioning(spark, labelled):
    more = labelled.union(labelled).withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id().cast("string")))
    kept = make(spark, [tuple(r) for r in more.select("doc_id", "text", "lang").collect()], "doc_id long, text string, lang string")
    a, b = langid.fit(kept, rows_per_lang=9, max_rows=8), langid.fit(kept.repartition(7), rows_per_lang=9, max_rows=8)
    assert a.langs == ["en", "fr"] and np.allclose(a.planes, b.planes, atol=1e-4)


def test_language_ties_and_margins_by_hand(spark, labelled):
    model = langid.fit(labelled)
    texts = sentences(2, 6)
    m = model.margins(pa.array(texts))
    for i, t in enumerate(texts):
        x = langid.feature_rows(pa.array([t]))[0]
        assert np.allclose(m[i], model.planes @ x + model.bias, atol=1e-3)
    even = langid.LangModel(["de", "en"], ["germanic"], np.zeros((2, 1 << langid.BITS), np.float32), np.zeros(2), [(0, 1)])
    assert even.predict(pa.array(["abc"]))[0][0] == 0  # a tie goes to the first


def test_toxic_features_are_character_ngrams():
    def slow(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in t)
        return {t[i : i + n] for n in (4, 5, 6) for i in range(len(t) - n + 1)}

    present = toxicity.Present()
    texts = ["Слово и дело", "漢字漢字漢字", "A-b c!", "", "abc", "abcd", "é" * 9]
    for t, p in zip(texts, toxicity.code_points(pa.array(texts))):
        assert len(present(p)) == len(slow(t))
    assert not present.mark.any()


def test_toxic_segments_lose_no_ngram(monkeypatch):
    text = " ".join(sentences(3, 40))
    point = next(toxicity.code_points(pa.array([text])))
    whole = toxicity.Present()(point)
    monkeypatch.setattr(toxicity, "SEGMENT", 17)
    assert (toxicity.Present()(point) == whole).all()


def test_sparse_solver_agrees_with_the_dense_one():
    r = np.random.default_rng(0)
    dense = r.random((60, 40)) < 0.3
    square = r.random(40)
    y = np.where(dense[:, 0] | dense[:, 1], 1.0, -1.0)
    x = dense * np.sqrt(square)
    beta, b = linear.l2_svm(x @ x.T, y, linear.balanced(y), ridge=0.5)
    out, bias = linear.l2_svm_sparse([np.flatnonzero(d) for d in dense], square, y, linear.balanced(y), ridge=0.5, epochs=2000, tolerance=1e-9)
    assert abs(bias - b) < 1e-5 and np.allclose(dense @ out, x @ (x.T @ beta), atol=1e-5)


def test_quality_scores_are_density_differences(spark, labelled):
    labels = make(spark, [(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int")
    x = quality.with_statistics(labelled)
    model = quality.fit(x, labels)
    rows = x.join(labels, "doc_id").collect()
    z, y = np.array([r[quality.STATISTICS] for r in rows]), np.array([r.quality for r in rows])
    k, mean, scatter = z.shape[1], [], []
    for c in (0, 1):
        mean.append(z[y == c].mean(0))
        scatter.append((z[y == c] - mean[c]).T @ (z[y == c] - mean[c]))
    pooled = sum(scatter) / len(y)
    log = []
    for c in (0, 1):
        n = (y == c).sum()
        trust = 0.7 * n / (n + k)
        cov = trust * scatter[c] / n + (1 - trust) * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + np.diag(np.maximum(np.diag(pooled), 1e-6)) * 1e-2 + 1e-5 * np.eye(k)
        log.append([-0.5 * (v - mean[c]) @ np.linalg.inv(cov) @ (v - mean[c]) - 0.5 * np.linalg.slogdet(cov)[1] for v in z])
    want = linear.logistic(math.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)) + np.array(log[1]) - np.array(log[0]))
    got = {r.doc_id: r.score for r in quality.score(x, model).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


# --- 3


def test_blocks_of_items_agree_with_one(spark):
    items = make(spark, [("x,y", "one two three"), ("z", "four five six"), (None, "two three four"), (None, "five six seven"), ("z", "nine ten")], "item_id string, text string")
    d = make(spark, [(1, "zero one two three four five six seven"), (1, "zero one two three four five six seven"), (None, None), (3, "nine ten"), (4, "none")]).withColumns({"__n_hit": F.lit("mine"), "item_ids": F.lit(0), "__bits": F.lit(1), "__text0": F.lit(2)})
    one, many = decontam.measure(d, items), decontam.measure(d, items, block_words=2)
    assert one.columns == many.columns and sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    row = one.where("doc_id = 1").first()
    assert (row.n_words, row.n_hit, row.n_items, row["items"], row.item_ids, row["__n_hit"]) == (8, 7, 3, "x,y,z", ["x,y", "z", None], "mine")
    assert [r.text for r in decontam.remove_spans(one.where("doc_id in (3, 4)")).orderBy("doc_id").collect()] == ["", "none"]
    long = decontam.measure(make(spark, [(1, "a " * 200 + "nine ten " + "b " * 200 + "one two three")]), items)
    assert "nine" in decontam.remove_spans(long, max_words=2).first().text and "one two" not in decontam.remove_spans(long, max_words=2).first().text


# --- 4: the score against counts, divergence tests and a walk, all done anew


def slow_pst(train, texts, least=2, tail_least=4):
    stream = lambda t: b"\n" * pst.DEPTH + b" ".join([*(t or "").encode().lower().split(), b"\n"])
    count = [defaultdict(Counter) for _ in range(pst.DEPTH + 1)]
    for s in map(stream, train):
        for i in range(pst.DEPTH, len(s)):
            for k in range(pst.DEPTH + 1):
                count[k][s[i - k : i]][s[i]] += 1
    tree = {b""}
    for k in range(1, pst.DEPTH + 1):
        for ctx, c in count[k].items():
            total, up = sum(c.values()), count[k - 1][ctx[1:]]
            above = sum(up.values())
            gain = sum(n * math.log((n / total) / (up[s] / above)) for s, n in c.items())
            if total >= least and gain > len(c) * math.log(total) / 2:
                tree |= {ctx[j:] for j in range(k)}

    def p(ctx, s):
        c = count[len(ctx)][ctx]
        total = sum(c.values())
        return (c[s] + 1) / (total + 256) if not ctx else (c[s] + len(c) * p(ctx[1:], s)) / (total + len(c))

    def longest(s, i):
        return max(k for k in range(pst.DEPTH + 1) if s[i - k : i] in tree)

    def places(t):  # context that begins with a word, next symbol, the head's probability
        for w in (t or "").encode().lower().split():
            w += b" "
            for j in range(pst.DEPTH, min(len(w), pst.DEEP)):
                k = longest(w, j)
                yield w[:j], w[j], p(w[j - k : j], w[j])

    follow, head_p = defaultdict(Counter), {}
    for t in train:
        for ctx, s, q in places(t):
            follow[ctx][s] += 1
            head_p[ctx, s] = q
    tail = {}
    for ctx, c in follow.items():
        total = sum(c.values())
        gain = sum(n * math.log(n / total / head_p[ctx, s]) for s, n in c.items())
        if total >= tail_least and gain > len(c) * math.log(total) / 2:
            tail[ctx] = c, total, len(c)
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(pst.DEPTH, len(s)):
            k = longest(s, i)
            total += math.log10(p(s[i - k : i], s[i]))
        for ctx, s, q in places(t):
            if ctx in tail:
                c, n, kinds = tail[ctx]
                total += math.log10((c[s] + kinds * q) / (n + kinds) / q)
        out.append(total)
    return out, len(tail)


@pytest.mark.parametrize("head, size", [(pst.HEAD, 1 << 16), (0, 2), (10, 40)])
def test_lm_scores_by_a_slow_suffix_walk(spark, monkeypatch, head, size):
    texts = sentences(4, 30, 20) + ["", None, "Élan vital éé", "zzz qqq", "the same the same the same"]
    texts += ["tokenizer tokenizers tokenized tokenization", "tokenizer tokenization " * 4, "tokenizzz tokeni tokenization", "Élanvital Élanvitale élanvitales " * 2, "long" * 20]
    texts += [" ".join(f"{a}{b}nation{b}{a}{a}" for b in "ijk") + f" {a}inationz" for a in "abcdefgh"] * 6
    d = make(spark, list(enumerate(texts)))
    monkeypatch.setattr(pst, "BLOCK", size)
    monkeypatch.setattr(pst, "RANGE", size)
    model, training = pst.fit(d.where("doc_id % 3 <> 1"), max_states=1 << 20, head=head)
    got = {r.doc_id: r.score for r in pst.score(d, model, training).collect()}
    want, tail = slow_pst([t for i, t in enumerate(texts) if i % 3 != 1], texts)
    assert training.tail.count() == tail > 10
    for i, w in enumerate(want):
        assert abs(got[i] - w) < 1e-4 * max(1, abs(w)), texts[i]


def test_lm_tail_is_not_bounded_by_the_head(spark):
    words = [f"w{i:04x}stem{i:04x}" for i in range(300)]
    model, training = pst.fit(make(spark, [(i, " ".join([w] * 5)) for i, w in enumerate(words)]), max_states=16)
    assert model.retained <= 16 * pst.DEPTH + 1 and training.tail.count() >= 300


def test_equal_texts_are_no_hot_key(spark):
    d = make(spark, [(i, "the very same text") for i in range(400)] + [(i, None) for i in range(400, 800)])
    model, words = pst.fit(d, head=0)
    keys = pst.rows_of(d, model).where("n = 0").groupBy("key").count().agg(F.max("count")).first()[0]
    assert keys <= 8  # at most one a task and place in it
    assert pst.score(d, model, words).count() == 800


# --- 5


def test_repetition_shares_and_verdict(spark):
    r = random.Random(6)
    vocabulary = ["é", "bb", "ccc", "dddd", "e", "ff"]
    texts = ["\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 6))) for _ in range(120)] + [" ".join(f"w{k}" for k in range(60)), "one line here\n" * 9, None]
    for row in repetition.rules(make(spark, list(enumerate(texts)))).collect():
        t = row.text or ""
        w = WORD.findall(t)
        chars = max(1, sum(map(len, w)))
        over = False
        for n, limit in repetition.NGRAMS.items():
            c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            inside = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
            share = sum(len(w[j]) for j in inside) / chars
            assert abs(row[f"share_{n}"] - share) < 1e-12, t
            over |= share > limit
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += sum(map(len, WORD.findall(line))) if line in seen else 0
                seen.add(line)
        assert abs(row.dup_line_share - dup / chars) < 1e-12
        assert row.kept == (not row.base_failed and not over and dup / chars <= repetition.DUP_LINE_SHARE)


# --- 7


def test_selection_takes_the_surest_and_never_overlaps():
    trees, threshold = pii.fitted()
    r = random.Random(7)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    text = " ".join(r.choice([f'token = "{hexes(40)}"', f"call (555) {r.randint(100, 999)}-{r.randint(1000, 9999)}", "plain words", f"DE{r.randint(10, 99)}{r.randint(10**17, 10**18)}", f"SSN: {r.randint(100, 999)}-12-{r.randint(1000, 9999)}", "me@x.org"]) for _ in range(300))
    base = pii.base_spans(text)
    proposed = pii.candidates(text, base)
    assert proposed == [c for c in proposed if not any(a < c[1] and c[0] < b for a, b, _ in base)]
    p = trees.probability(np.array([pii.features(text, *c) for c in proposed]))
    sure = [c for c, q in zip(proposed, p) if q >= threshold[c[2]]]
    want = []
    for k in np.argsort(-p, kind="stable"):
        a, b, kind = proposed[k]
        inside = any(s <= a and b <= e and (s, e) != (a, b) and x == kind for s, e, x in sure)
        if proposed[k] in sure and not inside and not any(s < b and a < e for s, e, _ in want):
            want.append(proposed[k])
    assert pii.extra_spans(text, base, trees, threshold) == want and len(want) > 50


def test_planted_secrets_are_found():
    """Recall of generated secrets in forms that training_cases() does not draw from the same seed."""
    trees, threshold = pii.fitted()
    r = random.Random(99)
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both, three = lower + upper + digits, lower + upper + digits + "!#%&*?"
    one_digit = lambda a, n: (t := draw(a, n))[: n // 2] + r.choice(digits) + t[n // 2 + 1 :]
    dni = lambda: f"{(k := r.randrange(10**8)):08d}{'TRWAGMYFPDXBNJZSQVHLCKE'[k % 23]}"
    insee = lambda: f"{(k := r.randrange(10**12, 2 * 10**12))}{97 - k % 97:02d}"
    forms = {
        "hex token": lambda: ('token = "', draw("0123456789abcdef", 40), '"'), "cloud key": lambda: ("seen ", "AKIA" + draw(upper + digits, 16), " there"),
        "password": lambda: ("password: ", draw(both, 24), " and"), "letters": lambda: ('api_key = "', draw(lower + upper, 40), '"'), "very long": lambda: ("secret=", draw(both, 2000), " end"),
        "short password": lambda: ("password: ", one_digit(both, 12), " and"), "signs": lambda: ("password: ", one_digit(three, 20), " then"), "short token": lambda: ("token=", one_digit(both, 10), "\n"), "json": lambda: ('{"pwd": "', one_digit(three, 14), '"}'),
        "of six": lambda: ("Passwort: ", one_digit(both, 6), ". Und"), "said": lambda: ("the password is ", one_digit(lower + digits, 9), " now"), "signed token": lambda: ("auth: ", ".".join(draw(both + "_-", 32) for _ in range(3)), " end"),
        "ssn": lambda: ("SSN: ", f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}", " end"), "dni": lambda: ("DNI: ", dni(), " end"), "insee": lambda: ("sécurité sociale: ", insee(), " end"),
        "nino": lambda: ("NINO: ", f"{draw('ABCEGHJ', 2)} {draw(digits, 2)} {draw(digits, 2)} {draw(digits, 2)} {r.choice('ABCD')}", " end"), "steuer": lambda: ("Steuer-ID: ", f"{r.randint(10, 99)} {draw(digits, 3)} {draw(digits, 3)} {draw(digits, 3)}", " end"),
        "phone": lambda: ("call ", f"(555) {draw(digits, 3)}-{draw(digits, 4)}", " today"),
    }
    for name, form in forms.items():
        found = 0
        for _ in range(200):
            before, secret, after = form()
            text = f"some words {before}{secret}{after}"
            at = len("some words " + before)
            found += any(a <= at and b >= at + len(secret) for a, b, _ in pii.extra_spans(text, [], trees, threshold))
        assert found >= 180, (name, found)


def test_words_after_key_words_stay():
    trees, threshold = pii.fitted()
    texts = [
        "The password: required for all users.", "Enter the token: optional field", "secret: ingredient of the cake", "auth: disabled by default.", "password: please choose another one", "Our secret is patience and practice.",
        "Passwort: vergessen? Hier klicken.", "the token is expired, ask again", "Password: <your-password>", "token count: 12,345 in total", "auth time: 10:24:31 today", "password: see https://example.org/help", "access key: Alt+Shift and more", "credentials: username and password", "authors: Miller, Smith and others",
    ]
    wrong = [t for t in texts if pii.extra_spans(t, [], trees, threshold)]
    assert len(wrong) <= 1, wrong


def test_boosted_trees_by_hand():
    model = boosting.fit(np.array([[0.0], [1.0]] * 50), np.array([0.0, 1.0] * 50), rounds=20)
    assert (model.probability(np.array([[0.0], [1.0]])) > 0.5).tolist() == [False, True]


# --- 8


def test_budget_comes_as_near_as_any_choice():
    r = random.Random(8)
    worst = 0
    for _ in range(200):
        length = np.array(sorted(r.sample(range(0, 12), 4)))
        count = np.array([r.randint(1, 3) for _ in length])
        budget = r.randint(0, int((length * count).sum()))
        take = mixing.fit_budget(length, count, budget)
        assert (take >= 0).all() and (take <= count).all()
        best = max(s for c in itertools.product(*(range(n + 1) for n in count)) if (s := int((length * np.array(c)).sum())) <= budget)
        worst = max(worst, best - int((length * take).sum()))
    assert worst == 0


def test_one_length_in_many_documents_and_equal_rows(spark):
    rows = [(i, "a b c", "s", "en") for i in range(3000)] + [(7, "a b c", "s", "fr")] * 500 + [(i, "x " * (i % 9 + 1), "t", "en") for i in range(500)]
    d = make(spark, rows, "doc_id long, text string, source string, lang string")
    a = mixing.mix(d, keep=("lang",), group_rows=100)
    b = mixing.mix(d.repartition(9), keep=("lang",), group_rows=100, broadcast_rows=2)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect())) and a.columns[:3] == ["doc_id", "lang", "source"]
    taken = {r.source: r for r in a.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) < 3 for r in taken.values())


# --- the pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    items = sentences(9, 3, 20)
    long = sentences(10, 40, 60)
    docs = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(long)]
    docs += [(100, long[0], "en", "s0"), (101, long[1], None, None), (102, f"{items[0]} {long[2][:20]}", "en", "s1"), (103, "12 34 !!", "en", "s1"), (104, None, "en", "s2"), (None, long[3], "fr", "s2"), (105, f"{sentences(11, 1, 30)[0]} write to me@x.org", "fr", "s2")]
    d = make(spark, docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(f"{base}/documents.parquet")
    make(spark, list(enumerate(items)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {name: f(spark, docs, tables) for name, f in corpus_pipeline.STAGES}
    assert list(got) == ["language_id", "near_duplicates", "decontamination", "personal_data", "mixture"]
    ids = {name: Counter(r.doc_id for r in df.collect()) for name, df in got.items()}
    every = Counter(r.doc_id for r in docs.collect())
    assert every - ids["language_id"] == Counter([103, 104]) and set(r.lang for r in got["language_id"].collect()) <= {"en", "fr"}
    assert every - ids["near_duplicates"] == Counter([100, 101, None])
    assert every - ids["decontamination"] == Counter([102])
    assert ids["personal_data"] == ids["mixture"] == every
    text = {r.doc_id: r for r in got["personal_data"].collect()}
    assert text[105].text.endswith("write to [email]") and text[105].n_chars == len(text[105].text) and text[104].text is None
    assert all(df.columns == corpus_pipeline.COLUMNS for name, df in got.items() if name != "mixture")
    empty = docs.limit(0)
    assert all(f(spark, empty, tables).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_pipeline_is_its_stages_one_by_one(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert sorted(r.doc_id for r in got.collect()) == sorted([*range(40), 105])
    assert all(abs(r.t - r.target) <= 70 for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()) and "lang" in got.columns


def test_queries_return_the_columns_of_their_contracts(spark, tables):
    got = entries.QUERIES["op1_language_id"](spark, tables)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.where("held_out is null").count() == 0


def test_svm_memory():
    """op1_language_id, pipeline: what the driver's fit holds beside the Gram matrix is one matrix in double precision, not four."""
    n = 1200
    x = np.random.default_rng(3).normal(size=(n, 40)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    gram = x @ x.T
    tracemalloc.start()
    beta, b = linear.l2_svm(gram, y, linear.balanced(y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * 8 * n * n, peak / (8 * n * n)
    assert ((x @ (beta @ x) + b > 0) == (y > 0)).mean() > 0.98


def test_language_fit_by_parts():
    """op1_language_id: the fit by parts of the buckets is that of all buckets at once."""
    rng = np.random.default_rng(4)
    names = ["de"] * 30 + ["en"] * 30 + ["fr"] * 30
    x = (rng.poisson(0.3, (90, 1 << langid.BITS)) / 100).astype(np.float16)
    for k in range(3):
        x[30 * k : 30 * k + 30, 3000 * k : 3000 * k + 40] += np.float16(0.02)
    model = langid.train(x, names)
    wide = x.astype(np.float64)
    wide *= (scale := 1 / (wide.std(0) + 1e-3))
    ratio = np.sqrt((wide**2).sum(1).mean())
    y = np.repeat([1.0, 1.0, -1.0], 30)  # germanic against the rest
    beta, b = linear.l2_svm(wide @ wide.T / ratio**2, y, linear.balanced(y))
    want = beta @ wide * scale / ratio**2
    assert model.families == ["germanic", "romance"] and model.pairs == [(0, 1)]
    assert np.abs(model.planes[0] - want).max() < 1e-3 * np.abs(want).max() and abs(model.bias[0] - b) < 1e-3


def test_lm_words_of_trained_rows_are_not_gathered_again(spark, monkeypatch):
    """op4_lm_score: with `trained` only other rows are read for words, and all scores are the same."""
    texts = [*sentences(8, 60), None, "", "Mixed CASE words", "word " * 40]
    d = make(spark, [(i, t) for i, t in enumerate(texts * 2)])
    trained = F.col("doc_id") % 3 != 1
    model, training = pst.fit(d.where(trained), head=15)
    want = {r.doc_id: r for r in pst.score(d, model, training).collect()}
    asked, gather = [], pst.lexicon
    monkeypatch.setattr(pst, "lexicon", lambda docs, *a: asked.append(docs.count()) or gather(docs, *a))
    got = {r.doc_id: r for r in pst.score(d, model, training, trained=trained).collect()}
    assert asked == [sum(i % 3 == 1 for i in range(len(texts) * 2))] and got.keys() == want.keys()
    for i, r in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (r.n_tokens, r.n_known)
        assert abs(got[i].score - r.score) < 1e-9 and abs(got[i].base_score - r.base_score) < 1e-9


def test_places_and_span_hashes():
    """op4_lm_score: look-ups agree with a binary search, hashes with the polynomial, and first bytes with slices."""
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 500), np.arange(1000, 1200), [-(1 << 63), (1 << 63) - 1]]))
    for known in (keys, keys[:0], keys[:-1]):
        asked = np.concatenate([keys, keys[:-1] + 1, keys[1:] - 1])
        at, hit = pst.Places(known).find(asked)
        assert (at == np.searchsorted(known, asked)).all() and (hit == np.isin(asked, known)).all()
    text = ("Ein langes Wort: " + "x" * 5000 + " é 12 " + "donaudampfschifffahrtsgesellschaft ") * 3
    data, off = pst.stream(pa.array([text, None, "ab"]))
    starts, ends, _ = words_of(data, off)
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    byte = [int(x) for x in mix64(np.arange(1, 257, dtype=np.uint64))]
    slow = [(sum(byte[c] * pow(base, k, 1 << 64) for k, c in enumerate(data[a:b].tolist())) + int(b - a)) & mask for a, b in zip(starts, ends)]
    assert span_hash(data, starts, ends).tolist() == mix64(np.array(slow, np.uint64)).tolist()
    first = pst.first_bytes(data, starts, ends).to_pylist()
    assert first == [(bytes(data[a:b]) + b" ")[: pst.DEEP] if b - a >= pst.DEPTH else None for a, b in zip(starts, ends)]


def test_lm_context_levels_are_one_table(spark):
    """op4_lm_score: counts of next symbols after contexts of all lengths, against a slow count; the empty context stays at any corpus size."""
    data, off = pst.stream(pa.array(["ein zwei ein", "", "ÿ é"]))
    slow, grams = Counter(), Counter()
    for a, b in zip(off[:-1], off[1:]):
        for i in range(a + pst.DEPTH, b):
            grams[int.from_bytes(bytes(data[i - pst.DEPTH : i + 1]))] += 1
            for k in range(pst.DEPTH + 1):
                slow[k << 8 * pst.DEPTH | int.from_bytes(bytes(data[i - k : i])), int(data[i])] += 1
    levels = pst.levels_of(spark.createDataFrame(list(grams.items()), "key long, n long"))
    assert {(r.node, r.sym): r.n for r in levels.collect()} == slow
    often = pst.frequent_contexts(levels, 10**6).collect()
    assert {r.node for r in often} == {0} and {r.total for r in often} == {sum(grams.values())}
