"""Personal data against a plain version, with nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from paperloom.llm import disclosure

#: The base patterns as they are given.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SCHEMA = "doc_id long, text string, key string, kind string, found string, n string, start string"
SPACE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text: str) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if valid(k, m[0])]


def plain(docs: list[tuple], near=disclosure.NEAR, support=disclosure.SUPPORT, share=disclosure.SHARE) -> list[tuple]:
    texts = Counter(t for _, t, *_ in docs)
    company, holds = defaultdict(set), defaultdict(set)
    for text in set(texts) - {None}:
        for kind in PATTERNS:
            hits = list(PATTERNS[kind].finditer(text))
            for i, m in enumerate(hits):
                if not valid(kind, m[0]):
                    continue
                low, high = hits[i - 1].end() if i else 0, hits[i + 1].start() if i + 1 < len(hits) else len(text)
                left, right = text[low : m.start()], text[m.end() : high]
                left = re.sub(r"^[^\W\d_]+", "", left[-near:]) if len(left) > near else left
                right = re.sub(r"[^\W\d_]+$", "", right[:near]) if len(right) > near else right
                value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                holds[kind, value].add(text)
                for term in {w.lower() for w in SPACE.findall(f"{left} {right}")}:
                    if len(term) >= disclosure.LETTERS:
                        company[kind, value, term].add(text)
    stands: Counter = Counter()
    for text, n in texts.items():
        stands.update({w: n for w in {w.lower() for w in SPACE.findall(text or "")}})
    told = set()
    for (kind, value, term), met in company.items():
        entity, n, together = sum(texts[t] for t in holds[kind, value]), len(docs), sum(texts[t] for t in met)
        if len(met) >= support and n > entity and math.log2(together * n / (entity * stands[term])) >= share * math.log2(n / entity):
            told |= {(text, term) for text in met}
    out = []
    for doc, text, *_ in docs:
        spans = base(text or "")
        spans += [("term", m.start(), m.end()) for m in SPACE.finditer(text or "") if (text, m[0].lower()) in told and not any(a <= m.start() < b for _, a, b in spans)]
        out.append((doc, sorted(spans, key=lambda s: (disclosure.KINDS.index(s[0]), s[1]))))
    return out


def documents():
    rng = random.Random(8)
    filler = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "日本語", "to", "of"]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs += [(100 + i, f"{text(8)} Zanzibar engineer {text(i)} jane.doe@example.com {text(5)} {text(i)}") for i in range(6)]  # a term that tells
    docs += [(120 + i, f"{text(i)} from 10.0.0.{i} calls Kestrel +1 (555) 010-{1000 + i} {text(9)}") for i in range(4)]
    docs += [(130 + i, f"{text(3 + i)} nearby osprey, 192.168.7.9; {text(50)} osprey {text(4)}") for i in range(5)] + [(140, "an Osprey elsewhere")]
    odd = ["a@b", "a@b.c_d@e.f", "a@b.c%d@e.f.g", "x@@y.z", "%@-.-", "é.a@b.cé", "ünd.3@mail.example", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3", "01.002.0003.255", "1.2.3.4.", "a.b.c.d@e-f.g.h.", "4111 1111-1111 1111", "4111111111111111222233334444",
           "+1+12 345 678 9", "+49 (30) 1234-5678.", "+1 23", "+1234567890123456", "++12345 67890", "4111  1111", "0000000000000", "a@b.c,d@e.f;1.1.1.1-2", "\n\t", "x@y.z\n1.1.1.1\n+12 345 678 90", "𝒳𝒴 a@b.co 𝒳 1.2.3.4"]
    docs += [(200 + i, t) for i, t in enumerate(odd)]
    docs += [(300, None), (301, ""), (None, "me@null.example"), (None, "me@null.example"), (100, docs[60][1]), (7, docs[61][1]), (8, docs[61][1])]
    docs += [(400, ("word " * 40 + "who@long.example 9.9.9.9 +44 20 7946 0958 4111111111111111 ") * 300), (401, "1" * 3000 + "a" * 3000 + "@" + ".b" * 30_000 + "+" + "1-" * 2000)]
    return [(*d, "k", "x", "f", "n", "s") for d in docs]


def as_lists(found):
    return Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["found"])) for r in found)


@pytest.mark.parametrize(("near", "most"), [(160, 200_000), (12, 0)])
def test_findings(spark, near, most, monkeypatch):
    monkeypatch.setattr(disclosure, "NEAR", near)
    monkeypatch.setattr(disclosure.disclosed, "__defaults__", (disclosure.SUPPORT, disclosure.SHARE, most))
    docs = documents()
    expected = plain(docs, near)
    assert as_lists(disclosure.scan(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()) == Counter((d, tuple(s)) for d, s in expected)
    assert sum(k == "term" for _, s in expected for k, *_ in s) >= 10 and all(any(k == kind for _, s in expected for k, *_ in s) for kind in disclosure.KINDS)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert disclosure.scan(none).count() == 0 and disclosure.sanitised(none).count() == 0


def test_sanitised_texts(spark):
    docs = documents()
    frame = spark.createDataFrame(docs, SCHEMA)
    out = disclosure.sanitised(frame)
    assert out.columns == frame.columns
    found, expected = Counter((r["doc_id"], r["text"]) for r in out.collect()), Counter()
    marks = {}
    for (doc, text, *_), (_, spans) in zip(docs, plain(docs), strict=True):
        new, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], disclosure.KINDS.index(s[0]))):
            if kind == "term":  # of those that tell here, osprey alone stands elsewhere
                marks[text[a:b].lower()] = "[term]" if text[a:b].lower() in ("osprey",) else ""
            new += [text[at:a], marks[text[a:b].lower()] if kind == "term" else f"[{kind}]"]
            at = max(at, b)
        expected[doc, None if text is None else "".join([*new, text[at:]])] += 1
    assert found == expected and "zanzibar" in marks


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "a@b" + ".c" * 300_000]
    assert disclosure.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
