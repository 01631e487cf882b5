import hashlib
import random
import re
from itertools import product
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import pii
from murmuration.llm.pii import EMAIL, KINDS, Finder, base_spans, emails, find_pii, fit_finder, lattice_of, luhn, masked, stretches
from murmuration.llm.queries import QUERIES
from murmuration.llm.semicrf import Lattice, SemiCRF

LITERAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def literal_spans(text):
    """The patterns word for word."""
    out = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


ODD = [
    "",
    "a@b.c, x.y@d-e.f.g. @no.local z@nodot 1@2.3",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3 a12.3.4.5b 1.2.3.4567",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112",
    "4111111111111111 4111111111111111",
    "+1 (017) 555-7713 +1 (017) 555-7713 1.2.3.4, +123456789. + 12 +1--2",
    "é4111111111111111é ١٢٣.٤.٥.٦ +١٢٣٤٥٦٧٨٩",
    "0" * 3000 + " x@" + "y" * 500,
]


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("0")


@pytest.mark.parametrize("text", ODD)
def test_base_is_as_the_patterns_say(text):
    assert base_spans(text)[0] == literal_spans(text)


def test_base_on_random_texts():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice("0123456789..  -+@ab()") for _ in range(rng.randrange(60)))
        assert base_spans(text)[0] == literal_spans(text), text


def paths(lattice, types):
    """All segmentations."""
    n = len(lattice.plain)

    def go(t):
        if t == n:
            yield []
            return
        for rest in go(t + 1):
            yield rest
        for (a, b, _), kind in product(lattice.segments, types):
            if a == t:
                for rest in go(b):
                    yield [(a, b, kind), *rest]

    return list(go(0))


def path_score(field, lattice, path):
    covered = {t for a, b, _ in path for t in range(a, b)}
    total = sum(field.plain.get(f, 0) for t, fs in enumerate(lattice.plain) if t not in covered for f in fs)
    features = {(a, b): fs for a, b, fs in lattice.segments}
    for a, b, kind in path:
        total += sum(field.weights[f][field.types.index(kind)] for f in features[a, b] if f in field.weights)
    return total


def test_dynamic_programming_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 5
        names = [f"f{k}" for k in range(6)]
        plain = tuple((str(rng.choice(names)),) for _ in range(n))
        spans = sorted({(int(a), int(min(n, a + 1 + rng.integers(3)))) for a in rng.integers(0, n, 6)})
        lattice = Lattice(plain, tuple((a, b, (str(rng.choice(names)), str(rng.choice(names)))) for a, b in spans))
        field = SemiCRF(("p", "q"), {f: rng.normal(size=2) for f in names}, {f: float(rng.normal()) for f in names})
        every = paths(lattice, field.types)
        scores = [path_score(field, lattice, p) for p in every]
        assert path_score(field, lattice, field.best(lattice)) == pytest.approx(max(scores))
        total, steps, spans_ = field.marginals(lattice)
        z = sum(map(exp, scores))
        assert exp(total) == pytest.approx(z)
        for k, (a, b, _) in enumerate(lattice.segments):
            for j, kind in enumerate(field.types):
                own = sum(exp(s) for s, p in zip(scores, every, strict=True) if (a, b, kind) in p)
                assert spans_[k][j] == pytest.approx(own / z)
        assert len(steps) == n


def test_the_field_finds_what_patterns_miss():
    rng = random.Random(1)

    def card():
        body = "".join(rng.choice("0123456789") for _ in range(15))
        return next(body + d for d in "0123456789" if luhn(body + d))

    made = []
    for _ in range(300):
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        made += pii.examples(rng.choice([card(), phone, ip, str(rng.randrange(10**6)), f"a.{rng.randrange(99)}@b.example.com"]))
    finder = Finder(SemiCRF(KINDS).fit(made))
    a, b = card(), card()
    base, every = finder.find(f"pay {a} {b} now")
    assert base == [] and every == [(4, 20, "card"), (21, 37, "card")]
    base, every = finder.find("call +1 (222) 555-1234 10.20.30.40 or not")
    assert base == [(23, 34, "ip")] and every == [(5, 22, "phone"), (23, 34, "ip")]
    assert finder.find("in 2024 the 123456789012 items") [1] == base_spans("in 2024 the 123456789012 items")[0]
    assert masked("call x@y.z or 1", [(5, 10, "email")]) == "call [email] or 1"


def test_lattices_stay_bounded():
    text = "1-" * 2000 + "a@b.c" * 500
    assert stretches(text) == [(0, len(text))]
    lattice, _ = lattice_of(text)
    assert len(lattice.segments) <= len(lattice.plain) * pii.MAX_TOKENS


def test_query_on_all_documents(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = literal_spans(docs[r.doc_id])
        joined = [f"{k}:{a}:{b}" for a, b, k in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans) and len(spans) == len(joined) + r.n_added


def test_null_empty_and_repeated(make_docs):
    rows = [(1, None), (2, ""), (2, "x@y.zz"), (2, "x@y.zz"), (None, "1.2.3.4")]
    docs = make_docs(rows).withColumn("spans", F.lit("mine")).withColumn("kind", F.lit(7))
    got = find_pii(docs, fit_finder(docs)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in got) == [
        ("1", 0, 0, ""),
        ("2", 0, 0, ""),
        ("2", 1, 0, "email:0:6"),
        ("2", 1, 0, "email:0:6"),
        ("None", 0, 1, "ip:0:7"),
    ]
    assert find_pii(docs.limit(0), fit_finder(docs.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_emails_from_their_signs_outwards(seed):
    import random

    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("ab1.-_%+@@é ,") for _ in range(rng.randrange(30)))
        assert list(emails(text)) == [m.span() for m in EMAIL.finditer(text)]


def test_very_long_runs_take_linear_time():
    import time

    n = 1_000_000
    start = time.perf_counter()
    for run in ("a" * n, "1" * n, "a." * (n // 2), "+1" + "(" * n, "@" * 1000 + "a" * n, "1." * (n // 2)):
        for text in (run, f"{run}@", f"x@{run}", f"{run} x@y.org"):
            base_spans(text)
    assert time.perf_counter() - start < 60
    assert base_spans("b" * n + "@x.org")[0] == [(0, n + 6, "email")]
