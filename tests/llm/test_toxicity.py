import math
import random

from brindle.llm import toxicity
from brindle.llm.toxicity import Lexicon, Settings, fold


def test_folding():
    assert fold("Yоu ST0P!D 1d1ot!!") == " you stopid idiot "
    assert fold("ｔｒａｓｈ, Trásh") == " trash trásh "  # accents tell words apart
    assert fold("") == "  "
    assert fold("a​b c-d") == " ab c d "


def hits(model, text):
    return Lexicon.hits(model.automaton(), fold(text))


def test_terms_prefixes_and_exceptions():
    m = Lexicon({" grub ": 2.0, " grim": 1.0, " grimly ": 3.0}, frozenset({"good grub"}), 1.0, 0.0)
    assert hits(m, "grub grubs") == (2.0, 1)
    assert hits(m, "grimmer") == (1.0, 1)
    assert hits(m, "grimly") == (3.0, 1)  # the longest at a place
    assert hits(m, "good grub, bad grub") == (2.0, 1)
    assert hits(Lexicon({}, frozenset(), 1.0, 0.0), "grub") == (0, 0)
    long = m.normalised(2.0, fold("x " * 500))
    assert 0 < long < m.normalised(2.0, fold("x " * 5))


def corpus(prose, n):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorg", "z0rg", "blatch", "BLATCH", "fremulous", "fremish"]))
        if i % 4 == 1:
            words[5:5] = ["dear", "zorg"]  # harmless in this phrase
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_terms_and_exceptions(spark, documents, prose):
    rows, labels = corpus(prose, 400)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = documents(rows)
    m = toxicity.learn(df, y.where("doc_id < 300"), s=Settings(support=4, purity=0.6, evidence=0.0))
    assert any(t.startswith(" blat") for t in m.weights) and any(t.startswith(" frem") for t in m.weights)
    got = {r.doc_id: r.score for r in toxicity.score(df, m).collect()}
    held = [(got[i] >= 0.5) == bool(t) for i, t in labels if i >= 300]
    assert sum(held) / len(held) > 0.95


def test_odd_rows(spark, documents):
    m = Lexicon({" grub ": 2.0}, frozenset(), 2.0, -2.0)
    rows = [(1, None), (2, ""), (None, "grub"), (3, "grub"), (3, "grub"), (4, "x" * 200_000), (5, "grub " * 50_000)]
    got = [(r.doc_id, r.hits, r.score >= 0.5) for r in toxicity.score(documents(rows), m).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, False), (2, 0, False), (None, 1, True), (3, 1, True), (3, 1, True), (4, 0, False), (5, 50_000, True)], key=str)
    assert toxicity.score(documents([]), m).collect() == []


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.learn(documents([(1, "a")]), none)
    assert [r.score < 0.5 for r in toxicity.score(documents([(1, "a"), (2, None)]), m).collect()] == [True, True]
    m = toxicity.learn(documents([(1, "a")]), spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(documents([(1, "a")]), m).count() == 1


def plain_score(m, text):
    """Every term tried at every place, without an automaton."""
    folded = fold(text or "")
    spared = [(b, b + len(p) + 2) for p in m.exceptions for b in range(len(folded)) if folded.startswith(f" {p} ", b)]
    total, hits = 0.0, 0
    for b in range(len(folded)):
        here = [t for t in m.weights if folded.startswith(t, b)]
        if here:
            term = max(here, key=len)
            if not any(s <= b and b + len(term) <= e for s, e in spared):
                total, hits = total + m.weights[term], hits + 1
    x = math.log(1 + 1000 * total / max(1, len(folded.split()))) if total else 0.0
    return 1 / (1 + math.exp(-(m.slope * x + m.offset))), hits


def test_against_a_plain_scorer(documents):
    rng = random.Random(8)
    words = ["grub", "grubs", "grim", "grimly", "Gr1mly", "good", "bad", "trash", "tr@sh", "тrash", "old", "x", "!!"]
    m = Lexicon({" grub ": 2.0, " grim": 1.0, " grimly ": 3.5, " tras": 0.5, " old grub ": 4.0}, frozenset({"good grub", "old trash", "good old grub"}), 0.8, -3.0)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(300)] + [(900, None), (901, "")]
    got = {r.doc_id: (r.score, r.hits) for r in toxicity.score(documents(rows), m).collect()}
    for i, t in rows:
        score, hits = plain_score(m, t)
        assert got[i][1] == hits and abs(got[i][0] - score) < 1e-9
    assert sum(h > 0 for _, h in got.values()) > 200


def test_weights_against_plain_counts(spark, documents, prose):
    rows, labels = corpus(prose, 400)
    s = Settings(support=4, purity=0.6, evidence=0.0)
    m = toxicity.learn(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), s=s)
    seen = {0: {}, 1: {}}
    for (_, text), (_, y) in zip(rows, labels):
        words = fold(text).split()
        for before, w in zip(["", *words], words):
            for term in [f" {w} "] * (len(w) > 2) + [f" {w[:k]}" for k in (4, 5, 6) if len(w) > k]:
                seen[y].setdefault(term, set()).add(before)
    n = {k: sum(y == k for _, y in labels) for k in (0, 1)}
    want = {}
    for term in sorted(seen[1], key=lambda t: (len(t.rstrip()), t)):
        p, q = len(seen[1][term]), len(seen[0].get(term, ()))
        weight = math.log((p + 0.5) / (n[1] + 1) / ((q + 0.5) / (n[0] + 1)))
        expected = p * n[0] / n[1]
        surprise = expected - q + (q * math.log(q / expected) if q else 0)
        pure = p / n[1] >= s.purity * (p / n[1] + q / n[0])
        if p >= s.support and pure and surprise >= s.evidence and weight > 0 and not any(term.startswith(t) for t in want):
            want[term] = weight
    assert m.weights.keys() == want.keys() and len(want) > 3
    assert all(abs(m.weights[t] - want[t]) < 1e-9 for t in want)
