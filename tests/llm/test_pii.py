import hashlib
import math
import random
import re
from collections import defaultdict

from peakloom.llm import pii
from tests.llm.data import frame, odd_documents, simple


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


TEXTS = [
    "é mail a.b+c@x-y.example.com, q@z and @b.c a@b.c@d.e x@.y a@b..c", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 1.2.3 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 378282246310005",
    "+1 (555) 123-4567 +1+2 (3) 4567890123456 +4912345678.", "1" * 400 + ".2.3.4 " + "4" * 30, "a" * 2000 + "@" + "b" * 2000 + ".c", "", None,
]


def test_base_spans():
    for t in TEXTS + [r[1] for r in odd_documents()]:
        assert pii.base_spans(t or "") == brute(t or "")


def test_query_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [r[:2] for r in odd_documents()]
    got = sorted((str(r.doc_id), r.base_sha256) for r in pii.find_personal_data(simple(spark, rows)).collect())
    assert got == sorted((str(i), hashlib.sha256(pii.render(brute(t or "")).encode()).hexdigest()) for i, t in rows)


def test_revealing_terms(spark):
    mail = "ann.lee@mail.example.com"
    told = [(k, f"filler{k} number{k} the engineer Zebulon writes from {mail} about topic{k} again{k}") for k in range(4)]
    plain = [(50 + k, f"the engineer and writes from about topic{k} words only here, number {k}") for k in range(60)]
    got = {r.doc_id: r for r in pii.find_personal_data(simple(spark, told + plain)).collect()}
    for k, t in told:
        at = t.index("Zebulon")
        assert f"term_remove:{at}:{at + 7}" in got[k].spans.split(",") and got[k].n_email == 1
        assert "Zebulon" not in pii.sanitise(t, got[k].spans) and mail not in pii.sanitise(t, got[k].spans)
        assert f":{t.index('engineer')}:" not in got[k].spans
    assert all(got[i].spans == "" for i, _ in plain)
    copies = [(k, told[0][1]) for k in range(9)] + plain
    assert all(r.n_terms == 0 for r in pii.find_personal_data(simple(spark, copies)).collect())


def test_empty(spark):
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def test_glued_and_far_terms_and_holders_without_terms(spark):
    mail, url = "ann.lee@mail.example.com", "/".join(["http:/"] + ["x9"] * 300)
    glued = [(k, f"filler{k} number{k} Zebulon:{mail} about topic{k}") for k in range(4)]
    far = [(10 + k, f"{k} Quillon {url} bob.ray@mail.example.com") for k in range(4)]
    bare = [(20 + k, f"cy@mail.example.com Marlow {k}" if k < 4 else "cy@mail.example.com") for k in range(14)]
    plain = [(50 + k, f"words about topic{k} only here, number {k}") for k in range(60)]
    got = {r.doc_id: r for r in pii.find_personal_data(simple(spark, glued + far + bare + plain)).collect()}
    for k, t in glued + far:
        at = t.index("Zebulon" if k < 10 else "Quillon")
        assert f"term_remove:{at}:{at + 7}" in got[k].spans.split(",")
    docs = simple(spark, bare + [(k, t + " Marlow") if k < 58 else (k, t) for k, t in plain])
    near = pii.scan(docs)
    found = pii.disclosures(docs, near.where("size(entities) > 0"), near.selectExpr("row", "inline(near)"), 74, generalise=0.0).where("term = 'marlow'").first()
    # 14 documents hold the entity, 12 the term, 4 both.
    assert abs(found.share - math.log2(74 * 4 / (14 * 12)) / math.log2(74 / 14)) < 1e-9


def small(digits):
    """int() refuses long runs."""
    d = re.sub("^0+", "", digits)
    return len(d) <= 3 and int(d or "0") <= 255


def test_long_runs_of_digits():
    long = "0" * 5000
    assert [m[1:] for m in pii.base_spans(long + ".1.2.3")] == [(1, 5006)]
    assert [k for _, k, _ in pii.base_spans(long + "256.1.2.3 " + "9" * 6000 + ".0.0.1 1.2.3." + long + "7")] == [1]
    draw = random.Random(2)
    for _ in range(300):
        parts = ["0" * draw.choice([0, 1, 9, 5000]) + str(draw.choice([0, 7, 255, 256, 99999])) for _ in range(4)]
        want = [(0, 1, len(".".join(parts)))] if all(map(small, parts)) else []
        assert [s for s in pii.base_spans(".".join(parts)) if s[1] == 1] == want


def test_random_texts():
    draw = random.Random(8)
    bits = ["a", "b.", "@", "x-y", ".", "1", "25", "255.", "+", " ", "-", "(4)", "4111111111111111", "é", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))
        assert pii.base_spans(text) == brute(text)


def brute_shares(texts, reach=6, support=3):
    """{(entity, term): share}, by loops over plain texts: entities are addresses, words end at blanks and entities."""
    mail = re.compile(r"[a-z]+@[a-z]+(?:\.[a-z]+)+")
    holds, has, beside, places = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for k, t in enumerate(texts):
        words = [(w, m.start()) for m in re.finditer(r"\S+", mail.sub(lambda m: " " * len(m[0]), t)) for w in [m[0]]]
        for w, _ in words:
            has[w.strip(".,;:!?\"'()").lower()].add(k)
        for e in mail.finditer(t):
            holds[e[0]].add(k)
            before, after = [w for w, at in words if at < e.start()][-reach:], [w for w, at in words if at >= e.end()][:reach]
            for w in before + after:
                term = w.strip(".,;:!?\"'()").lower()
                if len(term) >= 4 and term.isalpha():
                    beside[e[0], term].add(k)
                    places[e[0], term].add(tuple(before + after))
    n = len(texts)
    return {(e, t): math.log2(n * len(ks) / (len(holds[e]) * len(has[t]))) / math.log2(n / len(holds[e])) for (e, t), ks in beside.items() if len(places[e, t]) >= support and len(holds[e]) < n}


def test_added_spans_by_brute_force(spark):
    draw = random.Random(11)
    people, words = ["ann@mail.example", "bob@mail.example", "cy@post.example"], ["alpha", "bravo", "delta", "golf", "hotel", "india", "kilo"]
    texts = []
    for k in range(160):
        t = [draw.choice(words) + draw.choice(["", "", ",", "."]) for _ in range(18)]
        for p, person in enumerate(people):
            if draw.random() < 0.12:
                at = draw.randint(0, len(t))
                t[at:at] = [person]
                if draw.random() < 0.7:
                    t.insert(at, ["Zebulon", "Quillon", "Marlow"][p])
        if draw.random() < 0.02:
            t.insert(3, "Quillon")
        texts.append(" ".join(t))
    shares = brute_shares(texts)
    kind = lambda s: "term_remove" if s >= 0.9 else "term_generalise" if s >= 0.7 else None
    marked = {k: kind(s) for k, s in shares.items() if kind(s)}
    assert len(set(marked.values())) == 2
    mail = re.compile(r"[a-z]+@[a-z]+(?:\.[a-z]+)+")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(simple(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        words = [(m[0], m.start()) for m in re.finditer(r"\S+", mail.sub(lambda m: " " * len(m[0]), t))]
        want = {}
        for e in mail.finditer(t):
            for w, at in [x for x in words if x[1] < e.start()][-6:] + [x for x in words if x[1] >= e.end()][:6]:
                term = w.strip(".,")
                if (e[0], term.lower()) in marked:
                    want[at, at + len(term)] = max(want.get((at, at + len(term)), ""), marked[e[0], term.lower()])
        want = sorted([(a, f"{s}:{a}:{b}") for (a, b), s in want.items()] + [(m.start(), f"email:{m.start()}:{m.end()}") for m in mail.finditer(t)])
        assert got[k] == ",".join(s for _, s in want)
