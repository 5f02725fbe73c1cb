"""Whole operators against slow versions of themselves: sizes and targets of the mix, statistics of the quality model, base formats over a table, the toxicity score end to end."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import langid, mixing, pii, quality, toxicity
from tests.llm.test_operators import ODD, brute_spans, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 8


def slow_targets(size):
    """Water-filling by bisection on what a weight of 1 gets, with exact stops."""
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = sum(size.values())
    low, high = 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(3.0 * size[s], middle * weight[s]) for s in size) < total else (low, middle)
    return {s: min(3.0 * size[s], high * weight[s]) for s in size}


@pytest.mark.parametrize("seed", range(4))
def test_mix_by_brute_force(spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(mixing, "MAX_BUDGET", 40)  # budgets are narrowed by longest lengths before the programme
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", " "]) if r.random() < 0.1 else " ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 2, 3, 50, 400]))), r.choice([None, "a", "b", "b", "b", "c", "é", "Z"])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=7).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    wanted = slow_targets(size)
    assert sorted((x.doc_id, x.size, x.source_size) for x in got) == sorted((i, len(WORD.findall(t or "")), size[s]) for i, t, s in rows)
    taken, longest = Counter(), defaultdict(int)
    for x in got:
        assert math.isclose(x.target, wanted[x.source], rel_tol=1e-9, abs_tol=1e-6) and 0 <= x.taken <= 3 * x.size and x.taken == x.size * x.copies
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x.size)
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(longest[s], 0.01 * t), (s, taken[s], t)


# --- 6


def slow_statistics(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, some = len(words), max(len(words), 1)
    share = lambda pattern: math.sqrt(len(re.findall(pattern, raw)) / max(len(raw), 1))
    mean = sum(map(len, words)) / some
    lines = raw.count(b"\n") + (len(raw) > 0)
    triples = Counter(zip(words, words[1:], words[2:]))
    root = lambda k: math.sqrt(k / some)
    out = [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(sum(len(w) ** 2 for w in words) / some - mean**2, 0))), share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[#*$%&|<>{}\[\]\\^~=_@]"), share(rb"[.,;:]"), share(rb"[!?\"'()\-/+]"), share(rb"[\x80-\xff]"),
        len(set(words)) / some, root(sum(a == b for a, b in zip(words, words[1:]))), root(max(Counter(words).values(), default=0)), math.log1p(lines), math.log1p(len(raw) / max(lines, 1)),
        root(sum(bool(re.search(rb"[#*$%&|<>{}\[\]\\^~=_@]", w)) for w in words)), root(sum(w[-1:] in (b".", b"?", b"!") for w in words)), root(sum(k - 1 for k in triples.values())),
    ]
    return out


def test_quality_statistics_by_brute_force():
    r = random.Random(6)
    texts = ["", " ", "\n", "a", *("".join(r.choice("ab A.1#é\n\t!;天") for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(200)), "same same same same " * 9]
    got = quality.statistics(pa.array(texts))
    assert np.allclose(got, np.array([slow_statistics(t) for t in texts]), atol=1e-9)
    assert (quality.statistics(pa.array([None], pa.string())) == 0).all()


# --- 7


def test_base_formats_over_a_table(spark):
    r = random.Random(77)
    piece = lambda: r.choice(["me@x.org", "a.b@c-d.co.uk", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+49 30 1234567", "+1 (555) 123-4567", "plain", "é", "天", "a@b", "1.2.3.4.5"])
    rows = [(i, r.choice([" ", ", ", "", "\n"]).join(piece() for _ in range(r.randint(0, 9)))) for i in range(200)] + list(ODD)
    order = {k: n for n, k in enumerate(pii.BASE)}
    for x in pii.find(make(spark, rows)).collect():
        base = sorted(brute_spans(x.text or ""), key=lambda s: (s[0], order[s[2]]))
        assert x.base == ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[2] == k for s in base) for k in pii.BASE]
        spans = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in x.spans.split(",") if s]
        assert set(s for s in x.base.split(",") if s) <= set(x.spans.split(",")) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))
        extra = [s for s in spans if s[0] in pii.EXTRA]
        assert not any(a < e and s < b for _, s, e in extra for _, a, b in spans if (s, e) != (a, b))


# --- 2


def test_toxicity_score_is_the_sum_of_its_present_n_grams(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghé") for _ in range(5)) for _ in range(60)]
    bad = words[:6]
    docs = [(i, " ".join(r.choice(words[6:] + (bad * 4 if i % 3 == 0 else [])) for _ in range(12))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(any(w in t for w in bad))) for i, t in docs], "doc_id long, toxic int")
    model = toxicity.fit(make(spark, docs), labels)
    fresh = [" ".join(r.choice(words[6:]) for _ in range(12)) for _ in range(50)] + [" ".join([r.choice(bad), *(r.choice(words[6:]) for _ in range(11))]) for _ in range(50)] + ["", "abc"]
    got = model.score(pa.array(fresh))
    for text, score in zip(fresh, got):
        point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seen = set()
        for n in range(toxicity.ORDERS[0], toxicity.ORDERS[-1] + 1):
            for k in range(len(point) - n + 1):
                seen |= set(toxicity.Present()(point[k : k + n]).tolist()) - (set(toxicity.Present()(point[k : k + n - 1]).tolist()) | set(toxicity.Present()(point[k + 1 : k + n]).tolist()))
        assert abs(score - 1 / (1 + math.exp(-(model.bias + sum(model.weight[b] for b in seen))))) < 1e-9
    assert (got[:50] < 0.5).mean() > 0.9 and (got[50:100] > got[:50].max()).mean() > 0.9


def test_sample_within_a_number_of_features(spark):
    rows = spark.createDataFrame([(i, i % 2, n, b"") for i, n in enumerate([50, 10] * 30)], "id long, y int, n long, x binary")
    assert toxicity.within(rows, 10**6, 1) is rows
    got = toxicity.within(rows, 400, 1).collect()
    assert Counter(x.y for x in got) == {0: 4, 1: 20} and sorted(x.id for x in got) == sorted(x.id for x in toxicity.within(rows.repartition(5), 400, 1).collect())
    assert Counter(x.y for x in toxicity.within(rows, 1, 1).collect()) == {0: 1, 1: 1}


# --- 1


def test_close_languages_beyond_europe_meet_in_pairs(spark):
    """Each language has words of its own beside those it shares with the others of its family."""
    r = random.Random(1)
    alphabet = {"hi": "कखगघचछजझ", "mr": "कखगघचछजझ", "id": "abdegiklmn", "ms": "abdegiklmn", "tr": "abcçdeğıiş", "zh": "天地人山水火", "ja": "天地人山水火", "xx": "ἀβγδε"}
    shared = {a: ["".join(r.choice(a) for _ in range(4)) for _ in range(30)] for a in sorted(set(alphabet.values()))}
    own = {lang: ["".join(r.choice(a) for _ in range(5)) for _ in range(12)] for lang, a in alphabet.items()}
    text = lambda lang: " ".join(r.choice(own[lang] if r.random() < 0.4 else shared[alphabet[lang]]) for _ in range(25))
    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(alphabet) * 25)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {tuple(model.langs[k] for k in p) for p in model.pairs} == {("hi", "mr"), ("id", "ms"), ("ja", "zh")} and len(model.families) == 5
    fresh = [(lang, text(lang)) for lang in sorted(alphabet) for _ in range(20)]
    best, score = model.predict(pa.array([t for _, t in fresh]))
    assert np.mean([model.langs[k] == lang for k, (lang, _) in zip(best, fresh)]) > 0.95 and (score > 0).all()
    listed = [x for langs in langid.FAMILIES.values() for x in langs]
    assert len(listed) == len(set(listed)) and langid.family_of("xx") == "=xx"
