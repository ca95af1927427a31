"""The scan of lines for claims against a plain loop."""

import random
import re

from tessera.functions import claims
from tessera.operators import claim_scan

HEADS = [("Widget-Pro", "beats 40%", "40%"), ("Indexer", "best accuracy", "0.82 accuracy"), ("none", "x", "7%"), (None, "x", "7%")]
LINES = ["Widget beats 40% now", "accuracy 0.82", "the indexer", "", "plain words", "<!-- claim-scan: ignore-start -->", "<!-- claim-scan: ignore-end -->", "<!-- claim-scan: ignore-next-line -->", "gain 7%", "mmlu: 61.5", "about 40 % of it", "best accuracy so far"]


def plain(lines):
    """(line, claim, status) of one file."""
    out, block = [], False
    mark = lambda x, what: re.search(rf"<!--\s*claim-scan:\s*{what}\s*-->", x)
    for i, x in enumerate(lines):
        if mark(x, "ignore-start"):
            block = True
        elif mark(x, "ignore-end"):
            block = False
        elif not block and mark(x, "ignore-next-line"):
            out += [(i + 2, lines[i + 1].strip(), "ignored")] if i + 1 < len(lines) else []
        elif not block:
            around = " ".join(lines[max(0, i - 5) : i + 6]).lower()
            for p in (claims.PERCENT, claims.SCORE, claims.COMPARED, claims.NAMED):
                for m in re.finditer(p, x):
                    c = m[0].strip().lower()
                    digits = lambda t: {w for w in t.split() if any(d.isdigit() for d in w)}
                    ok = any(
                        (v in c or c in v or digits(v) & digits(c)) and (any("-".join(h.split("-")[:k]) in around for k in range(1, 9)) or phrase in around)
                        for h, phrase, v in (("widget-pro", "beats 40%", "40%"), ("indexer", "best accuracy", "0.82 accuracy"))
                    )
                    out.append((i + 1, m[0].strip(), "allowed" if ok else "unapproved"))
    return out


def test_as_by_a_loop(spark):
    rng = random.Random(3)
    files = {f: [rng.choice(LINES) for _ in range(rng.randrange(1, 30))] for f in range(12)}
    rows = spark.createDataFrame([(f, n + 1, x) for f, xs in files.items() for n, x in enumerate(xs)], "f int, n int, line string")
    heads = spark.createDataFrame(HEADS, "product string, claim string, value string")
    for most in (10**6, 6):
        judged = claim_scan.judged(claim_scan.found(rows, "f", "n", "line", most=most), heads, "f", "n")
        assert sorted(map(tuple, judged.collect())) == sorted((f, *x) for f, xs in files.items() for x in plain(xs))
    sums = {r.f: (r.detected, r.ignored, r.unapproved, r.ok) for r in claim_scan.by_file(judged, rows, "f").collect()}
    want = {f: [s for *_, s in plain(xs)] for f, xs in files.items()}
    assert sums == {f: (len(s), s.count("ignored"), s.count("unapproved"), "unapproved" not in s) for f, s in want.items()}
    none = claim_scan.judged(claim_scan.found(rows, "f", "n", "line"), heads.limit(0), "f", "n")
    assert none.where("status = 'allowed'").count() == 0
