"""Precision and recall of the spans that the personal-data classifier adds, on a labelled sample made by rule.

Half of the given names and all family names stand in no list of the library;
each true kind but spelled-out addresses has look-alikes of the same form.
"""

import random
from collections import Counter

from tempora.llm import pii

UNLISTED = "Yusuf Ingrid Tomasz Aoife Ravi Chiara Bjorn Noor Dmitri Keiko".split()
LISTED = "Alice Thomas Maria Peter Sophie Carlos".split()
FAMILY = "Okafor Lindqvist Marchetti Novak Haddad Brennan Castellan Weiss".split()
FILLER = "the report was late and nobody could find a copy of it in time so we left".split()


def sample(seed, n):
    """(text, start, end, kind, true) for n texts with one candidate each."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        area, local = f"{r.choice('23456789')}{r.randrange(20, 90)}", f"{r.randrange(200, 990)}-{r.randrange(1000, 9999)}"
        given, family = r.choice(LISTED if r.random() < 0.5 else UNLISTED), r.choice(FAMILY)
        ssn = f"{r.randrange(100, 660)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"
        kind, true, before, span, behind = r.choice([
            ("name", True, r.choice(["contact ", "signed ", "a letter by ", "her name is "]), f"{given} {family}", r.choice([" said so", " wrote back", ", phone below", " today"])),
            ("name", False, r.choice(["on the way to ", "near the ", "a visit to "]), f"{r.choice(['Mount', 'Port', 'Lake', 'New', 'Saint'])} {family}", r.choice([" Street", " University", " county", " river"])),
            ("name", False, "we read ", f"{r.choice(['National', 'General', 'First'])} {r.choice(['Assembly', 'Council', 'Agreement'])}", " papers"),
            ("national", True, r.choice(["call me at ", "phone: ", "mobile ", "fax "]), f"({area}) {local}", r.choice([" ext 4", " after six", " at home"])),
            ("national", False, r.choice(["order no ", "serial number ", "invoice number "]), f"{area}-{local}", r.choice([" units", " pieces", " was sent"])),
            ("ssn", True, r.choice(["SSN ", "social security number ", "tax id "]), ssn, r.choice([" dob 1980", " on file"])),
            ("ssn", False, r.choice(["part no ", "serial ", "order id "]), ssn, r.choice([" units", " pieces", " in stock"])),
            ("spelled", True, r.choice(["mail ", "contact ", "write to "]), f"{given.lower()}.{family.lower()} (at) {family.lower()} (dot) com", r.choice(["", " for details", " if you can"])),
        ])
        head = " ".join(r.choices(FILLER, k=r.randrange(3, 9))) + ". " + before
        out.append((head + span + behind + ". " + " ".join(r.choices(FILLER, k=5)), len(head), len(head) + len(span), kind, true))
    return out


def measure(spark, rows):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if s.kind not in pii.BASE} for r in pii.find_pii(df).collect()}
    right, told, there, by = 0, 0, 0, Counter()
    for i, (_, a, b, kind, true) in enumerate(rows):
        told += len(found[i])
        there += true
        by[kind, true, "n"] += 1
        # A name may be found with less or more than its two words; a number must be exact.
        hit = any(k == kind and (x < b and a < y if kind in ("name", "spelled") else (x, y) == (a, b)) for k, x, y in found[i])
        by[kind, true, "hit"] += hit
        right += true and hit
    return right / told, right / there, by


def test_added_spans_on_a_labelled_sample(spark):
    precision, recall, by = measure(spark, sample(1, 1200))
    assert precision >= 0.95 and recall >= 0.95, (precision, recall, by)


def test_a_voter_that_always_agrees_tells_nothing():
    posterior, reliability = pii.expectation_maximisation({("ssn", (1, 1, 1, 0)): 300, ("ssn", (1, 1, -1, 0)): 300, ("ssn", (1, 1, 0, 1)): 200, ("ssn", (1, 1, -1, -1)): 200, ("ssn", (1, 1, 1, 1)): 200})
    assert posterior["ssn", (1, 1, 1, 1)] > 0.9 > 0.1 > posterior["ssn", (1, 1, -1, -1)]
    assert abs(reliability["ssn", 0] - 0.5) < 0.05 < reliability["ssn", 2] - 0.5
