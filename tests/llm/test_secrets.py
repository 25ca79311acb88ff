"""Secret spans against a search by Python's regular expressions over all pairs of parts."""

import random
import re

from lakecurator.llm import secrets
from lakecurator.llm.secrets import KINDS, NEEDS, ROLES, STRONG, secret_spans
from tests.llm.corpora import corpus, frame, odd

HEX = "0123456789abcdef"
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def slow_spans(text, reach=400):
    text, found = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:", "(?ia:"), text):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(found)
    free = lambda a, b: not any(s < b and a < e for _, s, e in base)
    for kind, pattern in (("identifier", secrets.IDENTIFIER.replace("(?i:", "(?ia:")), ("secret", secrets.SECRET), ("endpoint", secrets.ENDPOINT)):
        for m in re.finditer(pattern, text):
            if kind == "secret" and not all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
                continue
            if free(*m.span()):
                found.append((kind, *m.span()))
    out = []
    for kind, start, stop in found:
        needs = NEEDS.get(kind, ())
        if all(any(ROLES[k] == role and abs(s - start) <= reach for k, s, _ in found) for role in needs):
            out.append((kind, start, stop, kind not in STRONG))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def made(rng):
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parts = [
        lambda: rng.choice(["password", "PassWord", "passwd", "secret", "TOKEN", "api_key", "apikey", "paſſword", "toKen"]) + rng.choice(["=", ": ", ' = "', "' : '", "==", " "]) + run(B64, rng.choice([3, 5, 6, 7, 30])),
        lambda: "secret: token:" + run(B64, 8),
        lambda: "AKIA" + run("ABCDEFGH0123", rng.choice([0, 1, 15, 16, 17, 30])),
        lambda: "AKIAAKIA" + run("XYZ9", rng.choice([11, 12])),
        lambda: run(HEX, rng.choice([23, 24, 40])),
        lambda: rng.choice(["user", "username", "user_id", "access_key_id", "account", "superuser", "client_id"]) + rng.choice(["=", ": "]) + run("abcxyz", rng.choice([2, 3, 9])),
        lambda: run(B64, rng.choice([31, 32, 40])) + rng.choice(["", "=", "==", "==="]),
        lambda: rng.choice(["https", "postgres", "x" * 20, "s3+ssh"]) + "://" + run("abc.:/é", 12),
        lambda: " ".join(rng.choice(["wörd", "über", "word", "dead", "\n\n", "𝒳𝒴", "日本語"]) for _ in range(rng.choice([1, 4, 60]))),
    ]
    return rng.choice(["", " ", "é"]).join(rng.choice(parts)() + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.choice([1, 4, 12, 40])))


def checked(spark, texts, extra="", values=(), partitions=3):
    rows = [(i, t, *values) for i, t in enumerate(texts)]
    found = secret_spans(spark.createDataFrame(rows, "doc_id long, text string" + extra).repartition(partitions)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.spans] == slow_spans(texts[r.doc_id]), texts[r.doc_id]


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [made(rng) for _ in range(400)]
    kinds = {s[0] for t in texts for s in slow_spans(t)}
    assert kinds == set(KINDS)
    checked(spark, texts)


def test_candidates_need_their_complements(spark):
    key, run, url = "AKIA" + "Q7" * 8, "aB3" * 12, "https://host.example/x"
    far = " " * 500
    texts = [key, run, url, f"{key} {run}", f"{key} {url}", f"{run} {url}", f"{key} {run} {url}", f"{key}{far}{run}", f"{run}{far}{url} {key}", "user=anna", f"user=anna {run}", f"user=anna token=abcdef {url}"]
    found = {t: [s[0] for s in slow_spans(t)] for t in texts}
    assert [found[t] for t in texts] == [["access"], [], [], ["access", "secret"], ["access"], [], ["access", "secret", "endpoint"], ["access"], ["access"], [], ["identifier", "secret"], ["identifier", "assign", "endpoint"]]
    checked(spark, texts)


def test_reach_is_inclusive(spark):
    key, run = "AKIA" + "Q7" * 8, "aB3" * 12
    checked(spark, [f"{key}{' ' * n}{run}" for n in (379, 380, 381)] + [f"{run}{' ' * n}{key}" for n in (363, 364, 365)])


def test_odd_rows(spark):
    found = secret_spans(odd(spark)).collect()
    assert len(found) == 7 and all(r.spans == [] for r in found)
    text = "token = " + "ab" * 20 + " AKIA" + "Q7" * 8 + " " + "aB3" * 12
    rows = [(None, text)] * 3 + [(5, text)] * 4 + [(5, None), (None, ""), (6, "x" * 400_000 + text), (7, (text + "\n") * 1500)]
    found = secret_spans(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kind int, key string").repartition(4)).collect()
    count = lambda i: sorted(len(r.spans) for r in found if r.doc_id == i)
    assert count(None) == [0, 4, 4, 4] and count(5) == [0, 4, 4, 4, 4] and count(7) == [6000]
    assert [tuple(s) for r in found if r.doc_id == 6 for s in r.spans] == slow_spans(rows[-2][1])
    assert secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    secret_spans(frame(spark, corpus())).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
