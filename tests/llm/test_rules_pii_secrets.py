"""Quality rules, personal data and secrets beside plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadframes.llm import catalog, pii, quality_rules, secrets
from roadframes.llm.common import span_digest


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def shown(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_counts(both, all_texts):
    found = quality_rules.quality_rules(both)
    want = []
    for i, t in all_texts:
        c = counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert rows(found.drop("kept")) == shown(want)
    assert found.where("base_failed and kept").count() == 0
    assert found.where("kept").count() > 50


def test_cascade_order_does_not_matter(docs):
    rules = quality_rules.RULES
    profile = {r["rule"]: r for r in quality_rules.rule_profile(docs).collect()}
    assert set(profile) == {r.name for r in rules} and all(r["seen"] == docs.count() for r in profile.values())
    one, two = (quality_rules.quality_rules(docs, rules=r) for r in (rules, rules[::-1]))
    assert rows(one) == rows(two)


def test_no_rows(none):
    assert quality_rules.quality_rules(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert secrets.find_secrets(none, secrets.fit_secrets(none)).count() == 0


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_pii(text):
    text, out = text or "", []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15))
    for kind, pattern, fine in kinds:
        if kind == "email" and "@" not in text or kind == "ip" and "." not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if fine(m[0])]
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_pii_base(both, all_texts):
    found = pii.find_pii(both).select(
        "doc_id", F.sha2(span_digest(F.concat("email", "ip", "card", "phone")), 256).alias("d"))
    want = {i: digest(plain_pii(t)) for i, t in all_texts if i not in (8,)}
    got = {r["doc_id"]: r["d"] for r in found.collect()}
    assert {i: got[i] for i in want} == want


def test_pii_added_and_scores(odd):
    got = {r["doc_id"]: r for r in pii.find_pii(odd).collect()}
    assert [(s["start"], s["stop"]) for s in got[16]["iban"]] == [(5, 32)]
    assert got[16]["iban"][0]["score"] > 0.7  # "IBAN" stands before it
    assert [s["value"] for s in got[15]["phone"]] == ["+1 (555) 123-4567"]
    assert got[15]["phone"][0]["score"] == pytest.approx(0.9)
    assert all(0 <= s["score"] <= 1 for r in got.values() for k in ("email", "ip", "card", "phone", "iban") for s in r[k])


def test_pii_is_native(odd):
    plan = pii.find_pii(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_secrets(text):
    text, out = text or "", []
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_secrets_base(both, all_texts, docs):
    found = secrets.find_secrets(both, secrets.fit_secrets(docs))
    base = found.select("doc_id", F.sha2(span_digest(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("d"))
    assert rows(base) == shown((i, digest(plain_secrets(t))) for i, t in all_texts)
    for r in found.collect():
        own = [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] != "crf"]
        assert all(not (a < s["stop"] and s["start"] < b) for s in r["spans"] if s["kind"] == "crf" for a, b in own)


def test_crf_finds_what_patterns_miss(spark):
    """A model fitted on one half of documents with planted secrets finds those of another form in the other."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    blob = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    text = lambda secret: " ".join([word() for _ in range(30)] + [secret] + [word() for _ in range(30)])
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    train = [(i, text(f'token = "{blob(32, signs)}"' if i % 2 else word())) for i in range(300)]
    chain = secrets.fit_secrets(spark.createDataFrame(train, "doc_id long, text string"))
    tests = [(i, text(f'auth = "{blob(32, signs)}"' if i % 2 else word())) for i in range(100)]
    found = secrets.find_secrets(spark.createDataFrame(tests, "doc_id long, text string"), chain).collect()
    hit = {r["doc_id"] for r in found if any(s["kind"] == "crf" for s in r["spans"])}
    assert sum(i % 2 for i in hit) >= 40 and sum(1 - i % 2 for i in hit) <= 2


def test_viterbi_with_sure_tokens_is_exact(docs):
    """Stretches between sure tokens give the same tags as the chain over whole documents."""
    import numpy as np
    import pyarrow as pa

    from roadframes.llm import crf
    from roadframes.llm.textscan import chunks

    chain = secrets.fit_secrets(docs)
    column = pa.array([r["text"] for r in docs.collect()][:80])
    for chunk in chunks(column):
        tokens = secrets.Tokens(chunk)
        fast = secrets.decode(tokens, chain)
        scores, slow = chain.scores(tokens.features).astype(np.float64), []
        bounds = np.searchsorted(tokens.runs.doc, np.arange(chunk.n + 1))
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            tags = crf.viterbi(chain, scores[a:b]) if b > a else []
            at = None
            for k, tag in enumerate([*tags, secrets.O]):
                if tag != secrets.I and at is not None:
                    slow.append((d, at, a + k - 1))
                    at = None
                if tag == secrets.B or tag == secrets.I and at is None:
                    at = a + k
        assert fast == slow


def test_redaction(odd, docs):
    chain = secrets.fit_secrets(docs)
    out = secrets.redact_secrets(odd, chain)
    assert out.columns == odd.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert "qwertyuiop" not in got[13]["text"] and "[SECRET]" in got[13]["text"]
    assert got[1]["text"] is None and got[2]["text"] == "" and got[13]["n_chars"] == len(got[13]["text"])


def test_digests(spark):
    got = catalog.op2_secrets(spark, "/root/testdata/sf0.01").where("n_assign > 0").first()
    assert got["spans"].count("assign") == got["n_assign"]


def test_rare_secrets_are_learnt(spark):
    """Eight documents of 2,000 have a secret, and a uniform sample has none of them."""
    import random

    from roadframes.llm.common import hash_sample

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    blob = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    text = lambda secret: " ".join([word() for _ in range(30)] + [secret] + [word() for _ in range(30)])
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    sampled = {r["doc_id"] for r in hash_sample(ids, "doc_id", 200).collect()}
    rare = [i for i in range(2000) if i not in sampled][::220][:8]
    rows = [(i, text(f'token = "{blob()}"' if i in rare else word())) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in secrets.marked_rows(df).collect()} == set(rare)
    chain = secrets.fit_secrets(df, sample_docs=200)
    tests = [(i, text(f'auth = "{blob()}"' if i % 2 else word())) for i in range(100)]
    found = secrets.find_secrets(spark.createDataFrame(tests, "doc_id long, text string"), chain).collect()
    hit = {r["doc_id"] for r in found if any(s["kind"] == "crf" for s in r["spans"])}
    assert sum(i % 2 for i in hit) >= 40 and sum(1 - i % 2 for i in hit) <= 2
