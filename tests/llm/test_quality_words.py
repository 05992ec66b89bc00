"""Word order: the trigram tables against a plain model, and planted texts."""

import contextlib
import math
import os
import random
import re
import threading
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from concordia.llm import quality, word_model
from concordia.session import Scratch

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_log_perplexity(texts):
    """Interpolated modified Kneser-Ney in dictionaries, held out by halves."""
    half = {t: quality.text_key(t.encode(), "en") & 1 for t in texts}
    rows = {t: ["", ""] + [quality.normal_word(w) for w in t.split()] + [""] for t in texts}
    vocabulary = {w for r in rows.values() for w in r[2:]}
    out = {}
    for m in (0, 1):
        level = {3: Counter(g for t in texts if half[t] != m for g in zip(rows[t], rows[t][1:], rows[t][2:]))}
        for k in (2, 1):
            level[k] = Counter(g[1:] for g in level[k + 1])
        d, total, spare = {}, {}, {}
        for k in (1, 2, 3):
            n = Counter(level[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5 * i, 0.01), i - 0.01)
                            for i in (1, 2, 3)]
            total[k], spare[k] = Counter(), defaultdict(float)
            for g, c in level[k].items():
                total[k][g[:-1]] += c
                spare[k][g[:-1]] += d[k][min(c, 3)]

        def p(g):
            k = len(g)
            if not k:
                return 1 / len(vocabulary)
            below = p(g[1:])
            t = total[k][g[:-1]]
            c = level[k][g]
            return (c - d[k][min(c, 3)] + spare[k][g[:-1]] * below) / t if t else below

        for t in texts:
            if half[t] == m:
                grams = list(zip(rows[t], rows[t][1:], rows[t][2:]))
                out[t] = -sum(math.log(p(g)) for g in grams) / len(grams)
    return out


def sentences(rng, n, nouns, verbs, ends=("slowly", "today", "again")):
    return " ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)} a {rng.choice(nouns)} {rng.choice(ends)}" for _ in range(n))


def test_word_scores_equal_a_plain_model(spark):
    rng = random.Random(3)
    texts = sorted({sentences(rng, rng.randrange(1, 9), ["cat", "Dog", "log,", "12"], ["see", "eat"]) for _ in range(40)})
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts + texts[:3])], DOCUMENTS)
    # equal texts count as often as they are there
    with Scratch(spark, "t") as s:
        got = dict(map(tuple, quality.word_scores(docs.where(f"doc_id < {len(texts)}"), s).collect()))
    for t, x in plain_log_perplexity(texts).items():
        assert got[quality.text_key(t.encode(), "en")] == pytest.approx(x, rel=1e-9)


def test_spaceless_scripts_are_split():
    known = quality._WordHashes()
    a, b = (quality.word_hashes(t.encode(), known) for t in ("我喜欢猫", "我 喜 欢 猫"))
    assert len(a) == 7 and (a == b).all()


def test_planted_texts_are_rejected(spark, landed):
    rng = random.Random(9)
    stems = [f"{a}{b}{c}" for a in ("tor", "ban", "lim", "ker", "sul", "pad") for b in ("en", "ot", "ida", "ule", "ask")
             for c in ("", "er", "on", "is", "ly")]
    nouns, verbs, ends = stems[:90], stems[90:130], stems[130:]
    good = [sentences(rng, rng.randrange(10, 25), nouns, verbs, ends) for _ in range(300)]
    salad = []
    for text in good[:5]:
        words = text.split()
        rng.shuffle(words)
        salad.append(" ".join(words))
    other = [sentences(rng, 30, ["gato", "perro", "libro"], ["comer", "mirar"]).replace("the", "el").replace("will", "quiere")
             .replace(" a ", " un ") for _ in range(3)]
    notice = " ".join(stems[k % 150] + stems[(7 * k) % 150] for k in range(90))
    boilerplate = [f"{notice} {stems[k]}" for k in range(30)]
    texts = good + salad + other + boilerplate
    folder = landed(documents=spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS))
    got = {r["doc_id"]: r["kept"] for r in quality.op6_quality_rules(spark, folder).collect()}
    kept = [got[i] for i in range(len(texts))]
    assert sum(kept[:300]) >= 295
    assert not any(kept[300:305]), "word salad"
    assert not any(kept[305:308]), "another language"
    assert not any(kept[308:]), "boilerplate"


@pytest.fixture()
def small_groups(monkeypatch):
    for name, value in {"GROUP": 40, "HEAVY": 60, "WORDS": 150, "FREQUENT": 1 << 20}.items():
        monkeypatch.setattr(word_model, name, value)


def test_word_scores_of_many_groups_equal_a_plain_model(spark, small_groups):
    """Frequent middle words have groups of their own, texts are in parts, copies count as often as they are there."""
    rng = random.Random(4)
    texts = [sentences(rng, rng.randrange(1, 9), ["cat", "Dog", "log,", "12"], ["see", "eat"]) for _ in range(60)]
    texts = sorted({*texts, sentences(rng, 60, ["cat", "owl"], ["see", "go"])})
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS)
    other = docs.where("doc_id < 20").selectExpr("doc_id", "upper(text) text", "cast(null as string) lang", "source", "n_chars")
    with Scratch(spark, "t") as s:
        got = dict(map(tuple, word_model.word_scores(docs.unionByName(other), s).collect()))
    for t, x in plain_log_perplexity(texts).items():
        assert got[quality.text_key(t.encode(), "en")] == pytest.approx(x, rel=1e-9)
    assert len(got) == len(texts) + 20


def test_heavy_words_are_dealt(small_groups):
    plan = word_model.Plan(1000, {7: 130, 90: 61})
    assert plan.groups == 25 and plan.parts.tolist() == [4, 2] and plan.starts.tolist() == [25, 29]
    assert [plan.heavy_word(g) for g in (0, 24, 25, 28, 29, 30)] == [None, None, 7, 7, 90, 90]


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for x in (np.array([], np.uint32), np.sort(rng.integers(0, 1 << 32, 1000).astype(np.uint32)), np.array([3, 3, 1 << 31], np.uint32)):
        assert (word_model.unpack(word_model.pack(x, True), True) == x).all()
        assert (word_model.unpack(word_model.pack(x[::-1])) == x[::-1]).all()


def test_disk_of_word_scores(spark, landed):
    """Shuffled and written bytes that lie at a time, a trigram."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(1000)), "en", "s", 1) for i in range(300)]
    folder = landed(documents=spark.createDataFrame(rows, DOCUMENTS))
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    dirs = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]

    def lying(dirs):
        total = 0
        for top in dirs:
            for d, _, names in os.walk(top):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.path.getsize(f"{d}/{name}")
        return total

    with Scratch(spark, "t") as s:
        dirs.append(re.sub("^file:/*", "/", s.path))
        before, most, over = lying(dirs), [0], threading.Event()

        def watch():
            while not over.wait(0.02):
                most[0] = max(most[0], lying(dirs))

        watcher = threading.Thread(target=watch)
        watcher.start()
        quality.word_scores(spark.read.parquet(f"{folder}/documents.parquet"), s).collect()
        over.set()
        watcher.join()
    assert 0 < most[0] - before < 14 * 301 * 1000


def test_spelling_is_looked_up(monkeypatch):
    """The keys of texts are scored by a look-up each; only unknown ones are searched for, and a long text in sections."""
    monkeypatch.setattr(quality, "SLICE", 7)
    rng = random.Random(8)
    texts = [sentences(rng, rng.randrange(1, 9), ["Straße", "dog,", "猫"], ["see", "#1"]) for _ in range(20)] + ["", "a", None, "  x\ty  "]
    langs = ["en", "de", None] * 8
    rows = [pa.array(texts, pa.string()), pa.array(langs, pa.string())]
    batch = pa.record_batch(rows, ["text", "lang"])
    counted = pa.Table.from_batches(quality._count_grams(quality.ORDER)(iter([batch])))
    models, joined = {}, [b" ".join((t or "").encode().split()) for t in texts]
    for name in ("en", "de", quality.NO_LANGUAGE):
        own = [quality.grams(j) for j, x in zip(joined, langs) if j and (x or quality.NO_LANGUAGE) == name]
        keys, n = np.unique(np.concatenate(own), return_counts=True)
        mine = counted.filter(pc.equal(counted["lang"], name))
        assert dict(zip(mine["gram"].to_pylist(), mine["n"].to_pylist())) == dict(zip(keys.tolist(), n.tolist()))
        models[name] = quality.KneserNey(keys.astype(np.int64), n)
    expected = [-models[x or quality.NO_LANGUAGE].score(quality.grams(j).astype(np.int64)).mean() if j else None
                for j, x in zip(joined, langs)]
    asked, score = [], quality.KneserNey.score
    monkeypatch.setattr(quality.KneserNey, "score", lambda *a: asked.append(len(a[1])) or score(*a))
    got = quality._measure(SimpleNamespace(value=models))(*rows).field("spelling").to_pylist()
    assert got == [None if x is None else pytest.approx(x, rel=1e-12) for x in expected]
    assert sum(asked) == 0  # all of them are known
    unknown = quality.grams("zqzq xwxw".encode())
    assert (models["en"].scores(unknown) == score(models["en"], unknown.astype(np.int64))).all() and sum(asked) > 0
