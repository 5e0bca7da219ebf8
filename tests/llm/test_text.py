"""Quality rules, classifiers, BPE, language model, mixing and URL filter."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderline.llm import attention_lm, bpe, crf, language_crf, mixing, quality_crf, quality_rules, queries, url_filter
from tenderline.llm.common import table

from ..compare import duck, normal, same
from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, sf_dir):
    got = queries.queries()["op8_quality_rules"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.ratio >= r.threshold)
    left = [r for r in got if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in left if labels[r.doc_id] == 1]) > 0.98
    bad = [r.kept for r in left if labels[r.doc_id] == 0]
    assert not bad or np.mean(bad) < 0.2


def test_rules_cases(spark):
    labels = spark.createDataFrame([(5, 1, 0), (11, 1, 0), (18, 0, 0), (None, 1, 0), (18, 1, 0)], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark)
    got = quality_rules.judge(spark, docs, labels)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == Counter((r[0], *counts(r[1])) for r in cases.rows())
    kept = quality_rules.keep(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    none = labels.limit(0)
    assert quality_rules.judge(spark, docs, none).where("not base_failed and not kept").count() == 0
    assert quality_rules.judge(spark, cases.empty(spark), labels).count() == 0


def test_rules_learn_from_all_labels(spark, monkeypatch):
    """With every document trusted the two multinomials are equal, however many there are; a long list of labels gives the same as a short one."""
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("text"))
    weights, cut = quality_rules.fit(spark, docs, ids.withColumn("quality", F.lit(1)))
    assert np.allclose(weights, 0, atol=1e-12) and cut == -math.inf
    both = ids.withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int"))
    texts = docs.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.concat_ws(" good", F.split(F.substring("text", 1, 40), ""))).otherwise(F.concat_ws(" ", F.split(F.substring("text", 1, 40), ""))))
    short = quality_rules.fit(spark, texts, both)
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 5000)
    long = quality_rules.fit(spark, texts, both)
    assert np.array_equal(short[0], long[0]) and short[1] == long[1] and np.isfinite(long[1])


@pytest.mark.parametrize("flipped", [0, 10, 30])
def test_rules_threshold_with_flipped_labels(flipped):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(58, 8, 3300).round().astype(int), rng.normal(-2300, 500, 300).round().astype(int)
    held = Counter([(1, s) for s in good.tolist()] + [(int(k < flipped), s) for k, s in enumerate(bad.tolist())])
    cut = quality_rules._threshold([{"q": q, "s": s, "count": n} for (q, s), n in held.items()])
    assert np.mean(bad < cut) > 0.98 and np.mean(good >= cut) > 0.998


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 3])
    emit, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    m, log_z, pairs = crf.marginals(emit, lengths, trans, expected=True)
    at, total, want_pairs = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        weights, e = {}, emit[at : at + n]
        for path in np.ndindex(*[3] * n):
            weights[path] = math.exp(sum(e[k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        total += math.log(z)
        for k in range(n):
            for y in range(3):
                assert abs(m[at + k, y] - sum(w for p, w in weights.items() if p[k] == y) / z) < 1e-9
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                want_pairs[a, b] += w / z
        at += n
    assert abs(log_z - total) < 1e-9 and np.allclose(pairs, want_pairs)


def test_quality_classifier(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op1_quality_classifier"](spark, d).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_cases(spark):
    labels = spark.createDataFrame([(5, 1), (11, 1), (15, 0), (18, 0), (None, 0)], "doc_id long, quality int")
    docs = cases.frame(spark)
    for some in (labels, labels.limit(0)):
        out = quality_crf.classify(docs, quality_crf.learn(spark, docs, some)).collect()
        assert len(out) == len(cases.rows()) and all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
    model = quality_crf.learn(spark, docs, labels)
    assert quality_crf.classify(cases.empty(spark), model).count() == 0


def test_language(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op4_language_id"](spark, d).collect()}
    langs = {r.doc_id: r.lang for r in table(spark, d, "documents").collect()}
    held = [(langs[i], r.lang_pred) for i, r in got.items() if r.held_out and langs[i]]
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_switch():
    model = language_crf.fit(["the cat and the dog of the house " * 5, "der hund und die katze das haus " * 5], ["en", "de"])
    w = language_crf.words([b"the dog of the house und die katze das haus"])
    p = crf.marginals(language_crf.emissions(w, model.table).astype(float), w.per_text, model.trans)[0]
    assert [model.langs[k] for k in p.argmax(1)] == ["en"] * 5 + ["de"] * 5


def test_language_cases(spark):
    docs = cases.frame(spark)
    model = language_crf.learn(spark, docs)
    out = language_crf.identify(spark, docs, model).collect()
    assert len(out) == len(cases.rows())
    texts = Counter((r[0], r[1]) for r in cases.rows())
    assert all(r.lang_pred in {"en", "de", "und"} for r in out) and {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 16)} == {"und"} and texts
    assert language_crf.identify(spark, cases.empty(spark), model).count() == 0
    assert {r.lang_pred for r in language_crf.identify(spark, docs, language_crf.learn(spark, docs.limit(0))).collect()} == {"und"}


def test_bpe_against_the_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    for docs, some in ((table(spark, sf_dir, "documents"), rows), (cases.frame(spark), [r[:2] for r in cases.rows()])):
        want = Counter()
        for i, t in some:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            text = lib.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == want
    assert bpe.digests(cases.empty(spark)).count() == 0


def test_bpe_fuzz():
    import random

    tokenizers = pytest.importorskip("tokenizers")
    lib, v = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.vocabulary()
    random.seed(6)
    letters = "aabtheinsrl'd0 <|endoftext|>\n\té́ÉİßΣσ漢字\u00a0\u2028\u1c89😀"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["a" * 999, "<|endoftext|><|startoftext|>x"]
    ids = v.encode(texts)
    assert ids.to_pylist() == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert v.decode(ids).to_pylist() == [lib.decode(x, skip_special_tokens=False) for x in ids.to_pylist()]


def test_bpe_frames(spark):
    docs = cases.frame(spark)
    out = bpe.encode(docs, docs.columns, decoded=True)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    again = bpe.decode(out.select("doc_id", "ids"), ["doc_id"])
    assert Counter(r.decoded for r in again.collect()) == Counter(r.decoded for r in out.select("decoded").collect())


def lm_brute(rows):
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for i, t in rows:
        if i is not None and fold(i, 7) != 2:
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    return Counter(out)


@pytest.mark.parametrize("top", [200_000, 20])
def test_lm(spark, sf_dir, monkeypatch, top):
    monkeypatch.setattr(attention_lm, "TOP_WORDS", top)
    monkeypatch.setattr(attention_lm, "STEPS", 50)
    got = queries.queries()["op7_attention_lm"](spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_brute(rows)
    assert all(r.held_out == (fold(r.doc_id, 7) == 2) for r in got)


def test_lm_beats_the_base(spark):
    got = [r for r in queries.queries()["op7_attention_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_trains_on_every_learning_row(spark):
    texts = [cases.words(60, 200 + i) for i in range(4)]
    ids = attention_lm.Lexicon(None)([t.encode().split() for t in texts])
    counted = np.bincount(np.concatenate(ids), minlength=attention_lm.VOCABULARY).astype(float)
    code, start = attention_lm.Coding(counted, attention_lm.begins_word(), ids), attention_lm.init()
    for i, t in enumerate(texts):
        row = spark.createDataFrame([(i, t)], "doc_id long, text string")
        moved = attention_lm._average(spark, row, start, code, None)
        assert any((moved[k] != start[k]).any() for k in start)


def test_lm_cases(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 30)
    monkeypatch.setattr(attention_lm, "REMEMBERED", 50)
    docs = cases.frame(spark)
    got = attention_lm.scored(spark, docs, *attention_lm.learn(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_brute([r[:2] for r in cases.rows()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    none = cases.empty(spark)
    assert attention_lm.scored(spark, none, *attention_lm.learn(spark, none)).count() == 0
    model, words = attention_lm.learn(spark, none)
    assert {r.train_tokens for r in attention_lm.scored(spark, docs, model, words).collect()} == {0}


def test_lm_training_keeps_the_lexicon(spark, monkeypatch):
    """Tasks of one training share the worker's lexicon, and the weights do not depend on what it holds."""
    texts = [cases.words(60, 200 + i) for i in range(4)]
    ids = attention_lm.Lexicon(None)([t.encode().split() for t in texts])
    counted = np.bincount(np.concatenate(ids), minlength=attention_lm.VOCABULARY).astype(float)
    code, start = attention_lm.Coding(counted, attention_lm.begins_word(), ids), attention_lm.init()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).localCheckpoint()
    plain = attention_lm._average(spark, rows, start, code, None)
    some = list(dict.fromkeys(texts[0].encode().split()))
    kept = attention_lm._average(spark, rows, start, code, None, some, "kept")
    assert all((plain[k] == kept[k]).all() for k in start)


def test_lm_is_a_distribution():
    lex = attention_lm.Lexicon(None)
    ids = lex([b"one two three two one".split(), []])
    counted = np.bincount(np.concatenate(ids), minlength=attention_lm.VOCABULARY).astype(float)
    code = attention_lm.Coding(counted, attention_lm.begins_word(), ids)
    p = attention_lm.init()
    one = np.array([ids[0][0]], np.int32)
    after = lambda a: [np.append(one, np.int32(i)) for i in range(a, min(a + 8000, attention_lm.VOCABULARY))]
    total = sum((10 ** attention_lm.score(p, code, after(a))).sum() for a in range(0, attention_lm.VOCABULARY, 8000))
    assert abs(total / 10 ** attention_lm.score(p, code, [one])[0] - 1) < 1e-3


def unicode_space_rows():
    r = np.random.default_rng(4)
    parts = ["\u00a0", "\u00a0\u00a0", "\u3000", "\u0085", "\u2028", "\x1c", "a", "five", "hello", "'s", "é", "\u00a0x", "y\u00a0", "\u200b", "漢", "12", "\u00a0\u3000b"]
    return [(i, " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(1, 40)))) for i in range(60)] + [(99, "\u00a0 \u00a0 hello five \u00a0 \u00a0")]


def test_lm_words_do_not_depend_on_neighbours():
    enc = attention_lm.encoder()
    words = list(dict.fromkeys(w for _, t in unicode_space_rows() for w in t.encode().split()))
    alone = [enc.encode_ordinary(" " + w.decode()) for w in words]
    for some, want in ((words, alone), ([w for w in words if w.isascii()], [x for w, x in zip(words, alone, strict=True) if w.isascii()])):
        ids, each = attention_lm.spelled_words(None, some)
        assert each.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    lex = attention_lm.Lexicon(None)
    got = lex([t.encode().split() for _, t in unicode_space_rows()])
    assert [x.tolist() for x in got] == [[i for w in t.encode().split() for i in enc.encode_ordinary(" " + w.decode())] + [attention_lm.END] for _, t in unicode_space_rows()]


def test_lm_unicode_space_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 20)
    rows = unicode_space_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = attention_lm.scored(spark, docs, *attention_lm.learn(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def plain_score(p, code, ids):
    """log10 probability, one position after the other, straight from the definition."""
    n, total, stride = len(ids), 0.0, attention_lm.WINDOW - attention_lm.CONTEXT
    e = {k: v.astype(np.float64) for k, v in p.items()}
    starts = [0]
    while starts[-1] + attention_lm.WINDOW < n:
        starts.append(starts[-1] + stride)
    for s in starts:
        before = [code.begin if j == 0 else int(code.symbol[ids[j - 1]]) for j in range(s, min(s + attention_lm.WINDOW, n))]
        for i in range(len(before)):
            if s and i < attention_lm.CONTEXT:
                continue
            x = e["e"][before[: i + 1]]
            w = np.array([(x[i] @ e["q"]) @ (x[j] @ e["k"]) / math.sqrt(attention_lm.WIDTH) + e["near"][i - j] for j in range(i + 1)])
            w = np.exp(w - w.max())
            h = x[i] + (w / w.sum()) @ (x @ e["v"])
            g = h + np.maximum(h @ e["w1"] + e["b1"], 0) @ e["w2"]
            y = int(ids[s + i])
            log = lambda z, k: z[k] - z.max() - math.log(np.exp(z - z.max()).sum())
            c, u = int(code.klass[y]), int(code.slot[y])
            total += log(g @ e["c"] + e["cb"], c) + log(g @ e["s"][c] + e["sb"][c], u) + code.inside[y]
    return total / math.log(10)


def test_lm_score_against_a_plain_pass():
    lex = attention_lm.Lexicon(None)
    ids = lex([cases.words(n, 300 + n).encode().split() for n in (0, 1, 9, 40, 90)])
    counted = np.bincount(np.concatenate(ids), minlength=attention_lm.VOCABULARY).astype(float)
    code, p = attention_lm.Coding(counted, attention_lm.begins_word(), ids), attention_lm.init()
    sym, target, _ = attention_lm.windows(ids, code)
    attention_lm.train(p, sym, target, code, 40, 1e-2, 5)
    got = attention_lm.score(p, code, ids)
    for x, s in zip(ids, got, strict=True):
        assert abs(plain_score(p, code, x) - s) < 1e-3 * max(1, len(x))


def test_lm_windows_score_each_id_once():
    ids = [np.arange(n, dtype=np.int32) for n in (1, 31, 32, 33, 56, 57, 500)]
    code = type("C", (), {"symbol": np.arange(attention_lm.VOCABULARY), "begin": -1})
    sym, target, text = attention_lm.windows(ids, code)
    for k, x in enumerate(ids):
        mine = target[text == k]
        assert sorted(mine[mine >= 0].tolist()) == x.tolist()
    rows, cols = np.nonzero(target > 0)
    assert (sym[rows, cols] == target[rows, cols] - 1).all()


def test_lm_work_in_parts(monkeypatch):
    """Neither gradient nor scores depend on how much is worked on at a time, and windows after a text's first ask for no position twice."""
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 3000, n).astype(np.int32) for n in (1, 32, 33, 700, 90)]
    counted = np.bincount(np.concatenate(ids), minlength=attention_lm.VOCABULARY).astype(float)
    code, p = attention_lm.Coding(counted, attention_lm.begins_word(), ids), attention_lm.init()
    sym, target, text = attention_lm.windows(ids, code)
    cls, slot = attention_lm.coded(target, code)
    asked, plain = [], attention_lm._exp
    monkeypatch.setattr(attention_lm, "_exp", lambda z: (asked.append(z.size), plain(z))[1])
    loss, d = attention_lm.gradient(p, sym, cls, slot)
    asked.clear()
    scores = attention_lm.score(p, code, ids)
    later = len(text) - len(ids)
    assert sum(asked) == attention_lm.WINDOW * (len(text) * attention_lm.WINDOW - later * attention_lm.CONTEXT)
    for part, group, chunk in ((1, 1, 3), (7, 100, 5), (1000, 1 << 20, 1000)):
        monkeypatch.setattr(attention_lm, "PART", part)
        monkeypatch.setattr(attention_lm, "GROUP", group)
        monkeypatch.setattr(attention_lm, "CHUNK", chunk)
        other, e = attention_lm.gradient(p, sym, cls, slot)
        assert abs(other - loss) < 1e-5 * loss and d.keys() == e.keys() == p.keys()
        assert all(np.allclose(d[k], e[k], atol=1e-5 * np.abs(d[k]).max(), rtol=1e-3) for k in d)
        assert np.allclose(attention_lm.score(p, code, ids), scores, rtol=1e-6)


def test_lm_gradient():
    p, rng = attention_lm.init(), np.random.default_rng(0)
    sym, cls, slot = rng.integers(0, 50, (3, 32)), rng.integers(-1, 33, (3, 32)), rng.integers(0, 32, (3, 32))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    _, d = attention_lm.gradient(p, sym, cls, slot)
    for k in ("e", "q", "k", "v", "near", "w1", "b1", "w2", "c", "cb", "s", "sb"):
        at = tuple(rng.integers(0, n if k != "e" else 50) for n in p[k].shape)
        old, h = p[k][at], 1e-4
        p[k][at] = old + h
        up = attention_lm.gradient(p, sym, cls, slot)[0]
        p[k][at] = old - h
        down = attention_lm.gradient(p, sym, cls, slot)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * h) - d[k][at]) < 1e-3


def test_mixing(spark, sf_dir):
    df = queries.queries()["op5_mixing"](spark, sf_dir)
    same(df, mixing.SQL, sf_dir)
    by = df.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in by)


def test_mixing_cases(spark):
    docs = cases.frame(spark)
    out = mixing.mix(spark, docs).collect()
    assert len(out) == len(cases.rows()) and all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in out)
    assert {r.source for r in out} == {"s1", "s2", None}
    taken = mixing.take(spark, docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in out)
    assert mixing.mix(spark, cases.empty(spark)).count() == 0 and mixing.take(spark, cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(i, "a b", "x") for i in range(30)] + [(99, "", "y")], "doc_id long, text string, source string")
    got = mixing.mix(spark, one).collect()
    assert sum(r.taken for r in got) == 60 and {r.target for r in got if r.source == "y"} == {0.0}


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark, sf_dir):
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    got = queries.queries()["op9_url_filter"](spark, sf_dir).collect()
    same(queries.queries()["op9_url_filter"](spark, sf_dir), url_filter.SQL, sf_dir)
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_url_ratio_against_a_plain_model(spark, sf_dir):
    urls = [r.url for r in table(spark, sf_dir, "pages").collect()]
    body = lambda u: "\x02" * 3 + u.split("://", 1)[1].lower() + "\x03"
    tables = {}
    for u in urls:
        v = rule_of(u)[3]
        for i in range(3, len(body(u)) if v else 0):
            for k in range(4):
                t = tables.setdefault((v, body(u)[i - k : i]), Counter())
                t[body(u)[i]] += 1

    def prob(v, ctx, c):
        lower = 1 / url_filter.ALPHABET if ctx is None else prob(v, ctx[1:] if ctx else None, c)
        if ctx is None:
            return lower
        t = tables.get((v, ctx), {})
        return (t.get(c, 0) + len(t) * lower) / (sum(t.values()) + len(t)) if t else lower

    for r in url_filter.judge(spark, table(spark, sf_dir, "pages")).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").limit(15).collect():
        b = body(r.url)
        want = np.mean([math.log(prob("allow", b[i - 3 : i], b[i]) / prob("block", b[i - 3 : i], b[i])) for i in range(3, len(b))])
        assert abs(want - r.score) < 1e-5


@pytest.mark.parametrize("urls", [["http://a.com/x", "http://b.com/", "http://c.org/y"], ["http://a.net/fr/1", "http://b.net/es/", "http://c.org/y"], ["http://c.org/y", "x"]])
def test_urls_of_one_kind(spark, tmp_path, urls):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0], "http://c.org/" + "long/" * 5000])], "page_id long, url string")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    got = url_filter.judge(spark, pages)
    assert all(r.verdict == (r.rule and rule_of(urls[r.page_id % len(urls)])[3] or "allow") for r in got.where("page_id < 3").collect())
    names, rows = duck(url_filter.SQL.replace("FROM pages", f"FROM read_parquet('{tmp_path}/p/*.parquet')"), "/root/testdata/sf0.001")
    assert normal(got.columns, got.collect()) == normal(names, rows)


def test_url_cases(spark):
    rows = [(1, "http://COM/x"), (2, None), (3, ""), (4, "no scheme"), (5, "http://a.com"), (6, "https://m.example.com/en/?q"), (7, "x://www.example.com/en/a#b"), (8, "http://é.net/fr/"), (9, "http://b.net/es"), (None, "http://x.org/a"), (1, "http://COM/x"), (10, "://"), (11, "a://b://c/d")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, host string, n int")
    got = url_filter.judge(spark, pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got.collect()) == Counter((i, *rule_of(u)[:3]) for i, u in rows)
    assert url_filter.judge(spark, pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(spark, pages.where("page_id in (2, 3, 4)")).collect()} == {"allow"}
