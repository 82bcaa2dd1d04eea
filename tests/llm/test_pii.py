import random
import re

from helixframe.llm import pii as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(t):
    return {k: [m.span() for m in re.finditer(r, t or "") if good(k, m[0])] for k, r in BASE.items()}


def test_base_spans_and_additions(spark, docs):
    rnd = random.Random(5)
    bits = ["a", "b.c", "@", "x-y", ".com", "_", "%", " ", "1", "23", "255", "300", "4111111111111111", "5500-0000-0000-0004", ".", "-", "+", "+1 (386) 555-3733", "é", "日本", "(", ")", "10.0.0.1", "a@b.co", "0", "00", "\n", "1.2.3.4.5"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "1" * 2000, "1 " * 1000, "a.b@c.d," * 300, "1.2.3.4 " * 600, "mail me: bob (at) mail (dot) com or call (212) 555-1234 today", "+1 (386) 555-3733 is whole"]
    got = {r.doc_id: r for r in P.find_personal_data(docs(list(enumerate(texts)), ["spans", "email_base"])).collect()}
    for i, t in enumerate(texts):
        assert {k: [(s.start, s.end) for s in got[i][f"{k}_base"]] for k in BASE} == brute(t)
        base = [s for k in BASE for s in got[i][f"{k}_base"]]
        assert not [a for k in BASE for a in got[i][f"{k}_added"] for s in base if s.start < a.end and s.end > a.start]
    added = got[len(texts) - 2]
    assert [texts[-2][s.start : s.end] for k in ("email", "phone") for s in added[f"{k}_added"]] == ["bob (at) mail (dot) com", "(212) 555-1234"]
    assert P.find_personal_data(docs([])).count() == 0


def test_hostile_texts_take_linear_time(spark, docs):
    rows = [(0, "1" * 300_000), (1, "a" * 300_000 + "@"), (2, "1 " * 150_000), (3, "+1" + " " * 300_000), (4, "1." * 150_000)]
    assert P.find_personal_data(docs(rows)).count() == 5


def test_estimation_tells_labelers_apart():
    counts = {(1, 1, 1, 1): 50, (-1, -1, 0, -1): 40, (1, 1, 0, 1): 100, (-1, 1, 0, -1): 5, (0, 1, 1, 1): 3}
    post, chance = P.reliabilities(counts)
    assert post[1, 1, 1, 1] > 0.95 and post[-1, -1, 0, -1] < 0.05
    assert chance[0][1, 1] > chance[0][1, 0]
    assert P.classifier({}, {}) == [0.0] * len(P.features((0,) * 7))


def luhn_digit(digits):
    total = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def planted(rnd):
    """A text of one kind, the span that holds personal data (none if it only looks so), kind."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    group = lambda: f"{rnd.randrange(1, 65536):x}"
    name = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    kind, real = rnd.choice(list(BASE)), rnd.random() < 0.5
    if kind == "email":
        span = f"{name} (at) {name[::-1]}{rnd.choice([' (dot) ', '.', '[dot]'])}{rnd.choice(['com', 'org', 'de'])}" if real else f"{name[0]}({'at'}){digits(2)}.{digits(1)}"
        word = "mail me: " if real else "item "
    elif kind == "ip":
        span = ":".join(group() for _ in range(8)) if real else ":".join("0" for _ in range(7)) + f":{digits(2)}"
        word = "from host " if real else "version "
    elif kind == "card":
        body = "4" + digits(14)
        check = luhn_digit(body)
        whole = body + (check if real else str((int(check) + 5) % 10))
        span = ".".join(whole[i : i + 4] for i in range(0, 16, 4)) if real else ".".join(("9" + whole[1:])[i : i + 4] for i in range(0, 16, 4))
        word = "card " if real else "serial "
    else:
        span = f"({rnd.randint(2, 9)}{digits(1)}5) {rnd.randint(2, 9)}{digits(1)}4-{digits(4)}" if real else f"{rnd.choice('01')}{digits(2)}-{rnd.choice('01')}{digits(2)}-{digits(4)}"
        word = "call " if real else "part no "
    before = rnd.choice(["words here ", "", "we said "]) + (word if rnd.random() < 0.8 else "see ")
    return before + span + rnd.choice([" today", ".", ""]), (kind, len(before), len(before) + len(span)) if real else None


def test_added_spans_of_planted_data(spark, docs):
    rnd = random.Random(12)
    rows = [planted(rnd) for _ in range(1200)]
    # Base spans of all kinds, from which labelers are told apart as well.
    plain = ["mail a.b@mail.com now", "call +1 (386) 555-3733", "from 10.1.2.3 to host 8.8.8.8", "card 4111111111111111", "serial 4111111111111112", "ip 300.1.2.3"] * 20
    got = P.find_personal_data(docs(list(enumerate([t for t, _ in rows] + plain)))).collect()
    added = {(r.doc_id, k, s.start, s.end) for r in got for k in BASE for s in r[f"{k}_added"]}
    want = {(i, *x) for i, (_, x) in enumerate(rows) if x}
    assert all(re.fullmatch(P.WIDE[k].partition(")")[2], rows[i][0][a:b]) for i, k, a, b in added if k == "email")
    for kind in BASE:
        mine, true = {x for x in added if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(mine & true) / len(mine) >= 0.95 and len(mine & true) / len(true) >= 0.9, (kind, len(mine), len(true), len(mine & true))
