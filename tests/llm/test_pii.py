"""Personal data: the base grammar against the plain definition, the trees, and redaction."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from skyloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in match.split(".")) if kind == "ip" else None,
            "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = sorted((m.start(), i, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0]))
    joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
    return [sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_base_spans(odd_docs, docs_of):
    random.seed(4)
    rows = [(100 + i, "".join(random.choice("0123456789.-+ @ab(é😀_%\n") for _ in range(random.randint(0, 100)))) for i in range(1500)]
    rows += [(5000, "9" * 30_000), (5001, "a@b.c " * 500), (5002, "1." * 5000), (5003, "a@b.c_d@e.f x@y..z"), (5004, "+" * 3000),
             (5005, "4111 1111 1111 1111 and +44 20 7946 0958 at 10.0.0.255, 10.0.0.256")]
    docs = odd_docs.select("doc_id", "text").unionByName(docs_of(rows))
    model = pii.learn(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find_pii(docs, model).collect():
        counts, digest, joined = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == counts and r["base_sha256"] == digest
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert pii.personal_data(docs_of([])).collect() == []


WIDE_TEXTS = ["mail to ann(at)site.org", "write to bob [at] site [dot] co [dot] uk now", "my phone 212 555 0123 please call",
              "the host is 2001:db8:0:0:0:ff00:42:8329 today", "my card 4111.1111.1111.1111 is", "visa 4111_1111_1111_1112 no",
              "numbers 555 123 4567 alone", "x" * 70 + "(at)" + "y" * 80 + ".a.b.c.d.e.f.g", "no data 212 here", "",
              "mail a(at)b.c d(at)e.f, phone (212) 555-0199 or 212.555.0198x"]


def wide_brute(text, trees, levels):
    """Added spans by plain loops over the same patterns, features and trees."""
    base = [(m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if valid(k, m[0])]
    added = []
    side = lambda c: 0 if c == "" else 1 if c.isspace() else 2 if c.isalnum() else 3
    for i, kind in enumerate(pii.KINDS):
        at = 0
        matches = list(re.finditer(pii.WIDER[kind], text))
        for n, m in enumerate(matches):
            left = text[at:m.start()][-24:]
            behind = text[m.end():matches[n + 1].start() if n + 1 < len(matches) else len(text)][:1]
            at = m.end()
            others = re.sub("[A-Za-z0-9]+", "", m[0])
            case = (i, 1, min(len(re.sub("[^0-9]", "", m[0])) // 4, 5), min(len(re.split("[^A-Za-z0-9]+", m[0])), 6),
                    0 if not others else 1 if len(set(others)) == 1 else 2, int(bool(re.search(pii.CUES[kind], left.lower()))),
                    side(left[-1:]), side(behind))
            good = kind != "card" or valid("card", m[0])
            if good and pii.score(trees, case) >= levels[kind] and not any(s < m.end() and m.start() < e for s, e in base):
                added.append((m.start(), i, m.end()))
    return added


def test_added_spans_by_brute_force(docs_of):
    rows = [(i, f"call my phone +1 212 555 {1000 + i} now, mail bob{i}@site.org at 10.0.0.{i % 300}, card 4111 1111 1111 1111")
            for i in range(200)]
    rows += [(500 + i, f"order {i}: my card 4111.1111.1111.1111 is") for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(WIDE_TEXTS * 3)]
    trees, levels = pii.learn(docs_of(rows))
    assert all(level < math.inf for level in levels.values())
    kinds = set()
    for r in pii.find_pii(docs_of(rows), (trees, levels)).collect():
        text = dict(rows)[r["doc_id"]]
        added = wide_brute(text, trees, levels)
        kinds |= {k for _, k, _ in added}
        base = [(m.start(), i, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if valid(k, m[0])]
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + added))
    assert kinds == {0, 1, 2, 3}  # each kind adds wider spans


def test_small_tables_have_thresholds(docs_of):
    rows = [(i, t) for i, t in enumerate(WIDE_TEXTS)] + [(50, "mail a@b.org"), (51, "phone +1 212 555 1000")]
    _, levels = pii.learn(docs_of(rows))
    assert all(level < math.inf for level in levels.values())
    _, levels = pii.learn(docs_of([]))
    assert all(math.isclose(level, math.log(19)) for level in levels.values())


def test_threshold_weighs_cases_against_the_trees():
    own = math.log(19)
    assert math.isclose(pii.threshold([]), own)  # the trees alone
    assert pii.threshold([(1.0, 2000, 0), (0.5, 0, 2000)]) == 1.0  # many good cases lower it
    assert pii.threshold([(3.5, 20, 20)]) > 3.5  # bad ones raise it above themselves
    assert math.isclose(pii.threshold([(0.5, 1, 1)]), own)  # few cases change little


def test_many_matches_take_linear_time(docs_of, spark):
    import time

    text = "".join(f"10.0.{i % 256}.{i // 256 % 256} a{i}@b.co é " for i in range(50_000))
    docs = docs_of([(1, text)])
    start = time.time()
    row = pii.find_pii(docs, ([], dict.fromkeys(pii.KINDS, math.inf))).first()
    found = row["found"]
    assert (row["n_email"], row["n_ip"], len(found)) == (50_000, 50_000, 100_000)
    assert all(text[s["start"]:s["end"]] == (f"10.0.{i // 2 % 256}.{i // 512 % 256}" if i % 2 == 0 else f"a{i // 2}@b.co")
               for i, s in enumerate(found))
    redacted = pii.redact_documents(docs).first()["text"]
    assert redacted == "[IP] [EMAIL] é " * 50_000
    assert time.time() - start < 60


def test_boosting_separates():
    counts = [((0, 0, a, b, 0, 0, 0, 0), 90 if a > b else 5, 5 if a > b else 90) for a in range(4) for b in range(4)]
    trees = pii.boost(counts)
    assert all((pii.score(trees, case) > 0) == (p > n) for case, p, n in counts)


def test_redaction(odd_docs, docs_of):
    docs = docs_of([(1, "a@b.co, 10.0.0.1 é +44 20 7946 0958!"), (2, None), (3, "")]).withColumn("n_chars", F.lit(5).cast("long"))
    done = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact_documents(docs, length_col="n_chars").collect()}
    assert done == {1: ("[EMAIL], [IP] é [PHONE]!", 24), 2: (None, 5), 3: ("", 0)}
    assert pii.redact_documents(odd_docs).columns == odd_docs.columns
    assert pii.redact_documents(odd_docs).count() == odd_docs.count()


def test_overlapping_spans_become_one(spark):
    row = spark.sql("SELECT 'abcdefghij' AS text, array(named_struct('start', 2, 'kind', 0, 'end', 5), "
                    "named_struct('start', 4, 'kind', 1, 'end', 7)) AS found")
    assert pii.redact(row).first()[0] == "ab[EMAIL]hij"
