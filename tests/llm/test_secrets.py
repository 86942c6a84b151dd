"""Secret scans: patterns against a second reading of the contract, the network against finite differences and held-out secrets."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import secrets
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
HEX = "0123456789abcdef"


def brute(text):
    out = []
    for m in re.finditer(rf"""({KEY})["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def odd_texts():
    rng = random.Random(2)
    word = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    fixed = [None, "", " ", "token=secret=abcdefgh", "password: token: abcdefg", "PassWd='ab12-x'", "tokſn=abcdefgh toKen=abcdefgh", "api_key:short", "apikey = \"abc.def\"", "é☃ token=abcdef",
             "AKIA" + "Q" * 15, "AKIA" + "Q" * 16, "xAKIAAKIA" + "7" * 18, "f" * 23, "f" * 24, "0f" * 5000, "A" + "ab1" * 9, "token\n= abcdef", "token  =  'abcdef'", "x1" * 40_000]
    mixed = [" ".join(rng.choice([word(5, "abcxyz"), word(rng.randint(20, 30), HEX), f"secret{rng.choice('=:')}{word(rng.randint(3, 9), HEX)}", "AKIA" + word(rng.randint(14, 18), "ABC123"), "token", "="])
                      for _ in range(30)) for _ in range(60)]
    return fixed + mixed


def test_patterns():
    for text in odd_texts():
        assert secrets.pattern_spans(text or "") == brute(text or "")


def test_operator_on_odd_rows(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, None, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], None, "s", 1)], SCHEMA)
    for name in ("spans", "found", "text_", "value", "secrets", "score"):
        df = df.withColumn(name, F.lit("z"))
    out = secrets.find_secrets(df.repartition(3), keep=["doc_id", "text", "spans"]).collect()
    assert len(out) == len(texts) + 1 and {r.spans for r in out} == {"z"}
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.secrets if s.kind != secrets.MODEL] == brute(r.text or "")
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_columns(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op12_secrets"](spark, sf).collect():
        spans = brute(docs[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in secrets.KINDS)
        assert [x for x in r.spans.split(",") if x and not x.startswith("model:")] == [f"{k}:{a}:{b}" for k, a, b in spans]


def sample(rng, n):
    word = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda: " ".join(word(rng.randint(2, 7), "aeionrst") for _ in range(4))
    rows, label = [], []
    for i in range(n):
        secret = i % 2 == 0
        value = rng.choice([word(40, HEX), word(18, HEX), "AKIA" + word(16, "ABCDEFGHIJKLMNOP23")]) if secret else rng.choice([word(16, "0123456789"), f"mail{rng.randint(1, 9)}.{word(7, 'aeiort')}.com", f"10.24.{rng.randint(100, 255)}.177"])
        rows.append((prose() + (" token = \"" if secret else " "), value, " " + prose()))
        label.append(secret)
    return rows, np.array(label)


def test_gradients():
    rng = np.random.default_rng(0)
    p = secrets.new_parameters(1)
    codes, owner = secrets.encode(["ab c", "", "é", "p="], ["x9f", "qwe12", "AKIA99", "77"], ["zz", "", "", "end"])
    target, weight = np.array([1, 0, 1, 0], bool), np.array([1, 2, 0.5, 1])
    _, g = secrets.gradients(codes, owner, target, weight, p)
    for k in p:
        for i in rng.permutation(np.argwhere(g[k]))[:8]:
            i, sides = tuple(i), []
            for d in (1e-6, -1e-6):
                q = {a: b.copy() for a, b in p.items()}
                q[k][i] += d
                sides.append(secrets.gradients(codes, owner, target, weight, q)[0])
            assert abs((sides[0] - sides[1]) / 2e-6 - g[k][i]) < 1e-6


def test_windows_of_any_length_pool_alike(monkeypatch):
    rng = random.Random(4)
    rows, _ = sample(rng, 12)
    rows.append(("x", "q7" * 500, "y"))
    p, parts = secrets.new_parameters(2), list(map(list, zip(*rows)))
    whole = secrets.logits(*parts, p)
    monkeypatch.setattr(secrets, "POSITIONS", 37)
    assert np.allclose(whole, secrets.logits(*parts, p), rtol=1e-12)
    assert np.allclose(whole[3], secrets.logits(*[[x[3]] for x in parts], p), rtol=1e-12)


def test_learned_secrets_are_found_without_context():
    rng = random.Random(7)
    rows, label = sample(rng, 1200)
    model = secrets.fit_sample(rows, label, np.arange(1200) // 2 % 5)
    again = secrets.fit_sample(rows, label, np.arange(1200) // 2 % 5)
    fresh, truth = sample(random.Random(8), 400)
    value = [r[1] for r in fresh]
    score = model.scores([""] * 400, value, [""] * 400)
    cut = np.array([model.thresholds.get(secrets.alphabet(v), model.common) for v in value])
    assert (again.scores([""] * 400, value, [""] * 400) == score).all() and again.thresholds == model.thresholds
    assert (score >= cut)[truth].mean() >= 0.95 and (score >= cut)[~truth].mean() <= 0.01
    assert ((score >= 0) & (score <= 1)).all() and score[truth].mean() > 0.9 > 0.1 > score[~truth].mean()


def test_model_adds_spans_in_texts(spark):
    rng = random.Random(9)
    rows, label = sample(rng, 600)
    texts = [a + b + c for a, b, c in rows] + ["bare 7a9c3e51b07d2f4468 here", "call 4929111122223333 now"]
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.kind, s.start, s.end) for s in found[-2].secrets] == [("model", 5, 23)] and found[-1].secrets == []
    assert sum(any(s.kind == "model" for s in r.secrets) for r, y in zip(found, label) if not y) <= 3


@pytest.mark.parametrize("recall,n", [(0.99, 100), (0.99, 250), (0.5, 7), (1.0, 9), (0.99, 1)])
def test_threshold_keeps_recall(recall, n):
    scores = np.random.default_rng(n).random(n)
    cut = secrets.least_score(scores, recall)
    assert (scores >= cut).mean() >= recall and (scores > cut).mean() < recall


def test_calibration():
    rng = np.random.default_rng(6)
    z = rng.normal(size=4000)
    target = rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 0.5)))
    slope, shift = secrets.calibrate(z, target)
    assert abs(slope - 2) < 0.25 and abs(shift + 0.5) < 0.15
    slope, shift = secrets.calibrate(np.array([-50.0, -40, 30, 60]), np.array([False, False, True, True]))
    assert 0 < slope < 10 and np.isfinite(shift)


def test_all_candidates_take_part(spark):
    """Blocks of candidates learn together; a kind of secret that a sample of a few would miss gets a threshold and is found."""
    rng = random.Random(11)
    rows, label = sample(rng, 3000)
    texts = list(enumerate(a + b + c for a, b, c in rows))
    scanned = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), "text", ["doc_id"], ("s", "f")).localCheckpoint()
    distinct = scanned.select(F.inline("f")).select("before", "value", "after", "found").distinct()
    learn = distinct.withColumns({"rank": F.xxhash64("value", "before", "after")})
    good, bad = learn.where("found").count(), learn.where("NOT found").count()
    assert good + bad == learn.count() > 2 * 512
    one, many = (secrets.train_blocks(learn, good, bad, size) for size in (10**6, 512))
    fresh, truth = sample(random.Random(8), 400)
    value, none = [r[1] for r in fresh], [""] * 400
    for p in (one, many):
        z = secrets.logits(none, value, none, p)
        assert ((z > np.median(z)) == truth).mean() > 0.95
    model = secrets.fit(scanned, "f", 512)
    score = model.scores(none, value, none)
    cut = np.array([model.thresholds.get(secrets.alphabet(v), model.common) for v in value])
    assert (score >= cut)[truth].mean() >= 0.95 and (score >= cut)[~truth].mean() <= 0.02


def test_thresholds_and_calibration_of_tables_equal_those_in_memory(spark):
    rng = np.random.default_rng(3)
    z, found = rng.normal(size=500), rng.random(500) < 0.4
    kinds = [["hex", "word"][i % 2] for i in range(500)]
    rows = spark.createDataFrame([(float(a), bool(f), k, i, str(i), "", "", False) for i, (a, f, k) in enumerate(zip(z, found, kinds))], "z double, found boolean, kind string, rank long, value string, before string, after string, bare boolean")
    assert secrets.calibrate_rows(rows) == pytest.approx(secrets.calibrate(z, found), rel=1e-6, abs=1e-9)
    assert secrets._heights(rows, 0.9, []) == {None: secrets.least_score(z, 0.9)}
    assert secrets._heights(rows, 0.9, ["kind"]) == {k: secrets.least_score(z[np.array(kinds) == k], 0.9) for k in ("hex", "word")}
