import hashlib
import random
import re
import string
from zlib import crc32

import numpy as np

from tidewell.llm import secrets, toxicity

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans():
    rnd, parts = random.Random(1), ["password", "Token", "api_key", "APIKEY", "secret", " ", ":", "=", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "xyz", "é", "ſecret", "K", "\n", "0f"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert secrets.base_spans(t) == brute(t), t
    assert secrets.base_spans("token: secret: abcdefghijklmnop") == []


def test_op10(spark, docs, rows, none):
    rnd, letters = random.Random(3), string.ascii_letters + string.digits
    extra = [(1000 + i, "key " + "".join(rnd.choice(letters) for _ in range(rnd.randint(24, 60))) + " end") for i in range(60)]
    extra += [(2000 + i, f"see version2ofTheDocumentAndItsLongNameNumber{i} " + "a" * 30 + "1 " + "abc" * 9 + "123") for i in range(60)]
    extra += [(3000, "token = " + "Zz9" * 8 + " AKIA" + "Q7" * 8)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r[0]: r[1] for r in rows} | dict(extra)
    got = secrets.digest(df).collect()
    for r in got:
        b = brute(texts[r.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in b) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(r.spans.split(","))
    n = {r.doc_id: r.n_random for r in got}
    assert sum(n[1000 + i] == 1 for i in range(60)) >= 56 and not any(n[2000 + i] for i in range(60)) and n[3000] == 0
    assert sum(v for d, v in n.items() if d is None or d < 1000) == 0 and secrets.digest(none).isEmpty()


def test_short_keys_paths_and_keys_of_letters(spark):
    rnd, letters = random.Random(5), string.ascii_letters
    key = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    keys = [[key(letters + string.digits, 16 + i % 4) for i in range(60)], [key(letters + string.digits, 28) for _ in range(60)], [key(letters, 24) for _ in range(60)]]
    forms = "key {} end", "see /my-app/v1_x/{}/log-file now", "key {} end"
    plain = ["internationalization", "the_name_of_some_variable", "state-of-the-art-programming", "/home/user/documents/reports", "getAccountInformation", "-" * 40, "12345678901234567890123456"]
    data = [(1000 * k + i, form.format(x)) for k, (form, part) in enumerate(zip(forms, keys, strict=True)) for i, x in enumerate(part)]
    rows = data + [(9000 + i, f"a {plain[i % len(plain)]} b") for i in range(140)]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, part in enumerate(keys):
        caught = 0
        for i, x in enumerate(part):
            at = dict(data)[1000 * k + i].index(x)
            spans = [s.split(":") for s in got[1000 * k + i].split(",") if s]
            caught += any(kind == "random" and int(a) <= at and at + len(x) <= int(b) for kind, a, b in spans)
        assert caught >= 52, (k, caught)
    wrong = [plain[i % len(plain)] for i in range(140) if "random" in got[9000 + i]]
    assert not wrong, set(wrong)
    # A token with + and / is reported once, and not again by its parts.
    whole = key(letters + string.digits, 20) + "+" + key(letters + string.digits, 20) + "/" + key(letters + string.digits, 20)
    assert sorted(len(x[5]) for x in secrets.candidates(whole, [])) == [0, 1, 1, 1] and secrets.digest(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first().n_random == 1


def test_false_alarms_among_reports(spark):
    """Tokens whose p-values fall off towards one half are kept out once random ones show how many to expect; lone ones are not."""
    def scanned(ps):
        rows = [([], [{"start": 0, "end": 20, **secrets.classed(5, 5, p), "around": []}]) for p in ps]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], secrets.SCHEMA)

    rng = np.random.default_rng(1)
    flat = rng.random(2000)
    limit = lambda ps: secrets.thresholds(scanned([float(p) for p in ps])).first()["limit"]
    assert limit(flat) > 20
    mixed = np.concatenate([flat, 10 ** rng.uniform(-2.5, -1, 2000)])
    t = 10 ** (-limit(mixed) / 10)
    reported = mixed > t
    assert reported[2000:].sum() <= 0.12 * reported.sum() and reported[:2000].mean() > 0.7
    assert limit([0.3]) > 5 and limit([1e-9] * 5) <= 90


def test_battery_is_calibrated():
    rnd, low = random.Random(9), 0
    for _ in range(1500):
        token = "".join(rnd.choice("0123456789abcdef") for _ in range(64))
        low += secrets.combined(secrets.battery(token, 0)) < 0.05
    assert low / 1500 < 0.08
    for bad in ("0123456789abcdef" * 4, "0" * 40 + "a" * 24, "a1" * 32):
        assert secrets.combined(secrets.battery(bad, 0)) < 1e-4


def of_two(together):
    """Rows where ``together`` of the terms 1 and 2 makes a row toxic, and a model of them."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append([1] * int(a) + [2] * int(b) + [10 + int(rng.integers(40))])
        y.append(float(together(a, b)))
    return toxicity.fit(np.array([t for r in rows for t in r], np.uint32), np.array([len(r) for r in rows]), np.array(y))


def test_factors_learn_pairs():
    """Only the two terms together make a row toxic."""
    p = of_two(lambda a, b: a and b).scores([[1, 2, 12], [1, 12], [2, 12], [12], []])
    assert p[0] > 0.9 and max(p[1:]) < 0.2


def test_factors_learn_exactly_one_of_two():
    """Neither term tells anything alone, which no additive model can separate: the pair does."""
    m = of_two(lambda a, b: a != b)
    p = m.scores([[1, 2, 12], [1, 12], [2, 12], [12]])
    assert min(p[1:3]) > 0.65 and p[0] < 0.2 and p[3] < 0.5
    assert m.v[m.place[1]] @ m.v[m.place[2]] < -0.5
    additive = toxicity.Model(m.bias, m.place, m.w, m.r, np.zeros_like(m.v)).scores([[1, 2, 12], [1, 12], [2, 12], [12]])
    assert additive[0] > min(additive[1:3])


def test_op6(spark, none):
    rnd, data, labels = random.Random(4), [], []
    plain, insults, groups = [f"word{i}" for i in range(300)], ["slur", "snarl", "jeer"], ["easterner", "westerner"]
    for i in range(3000):
        w, toxic = [rnd.choice(plain) for _ in range(30)], int(rnd.random() < 0.25)
        if toxic:
            w += [rnd.choice(insults), rnd.choice(groups)]
        elif rnd.random() < 0.3:
            w += [rnd.choice(groups)]
        data.append((i, " ".join(rnd.sample(w, len(w)))))
        labels.append((i, toxic))
    data += [(5000, None), (5001, ""), (None, "slur easterner")]
    labels += [(5000, None), (None, 1), (99999, 1), (3, labels[3][1])]
    df, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(df, lab).collect()}
    held = [i for i in range(3000) if crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i in range(3000))
    right = sum(got[i].predicted == labels[i][1] for i in held) / len(held)
    assert right > 0.98 and got[5000].score == got[5001].score and got[5001].predicted == 0
    flipped = lab.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end toxic")
    again = {r.doc_id: r.score for r in toxicity.digest(df, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in range(0, 3000, 50))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.digest(df, empty).collect()} == {1 / (1 + np.exp(30.0))} and toxicity.digest(none, lab).isEmpty()
