"""Problem 6 against a plain walk."""

import random
import re

from subtide.llm.runs import collapse_runs


def _near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 2


def _alike(a, b):
    if not (a or "").strip() or not (b or "").strip():
        return False
    if a == b:
        return True
    la, lb = ("".join(c for c in re.sub(r"</?i>", "", x).lower() if c.isalpha()) for x in (a, b))
    da, db = ("".join(c for c in x if c.isdigit()) for x in (a, b))
    return da == db and ((la == lb and bool(la + da)) or (len(la) >= 12 and len(lb) >= 12 and _near(la, lb)))


def test_runs_equal_a_plain_walk(spark):
    rng = random.Random(2)
    said = ["abcdefghijklm", "abcdefghijkln", "abcdefghijXYn", "<i>Hey</i>", "hey!", "hey 2", "", None, " ", "?!", "...", "123"]
    rows, expected = [], {}
    for f in range(60):
        own = [(s, rng.choice(said)) for s in range(1, 41) if rng.random() < 0.95]
        rows += [(f, s, s * 10, s * 10 + 5, c) for s, c in own] + [(f, s, s * 10, s * 10 + 5, c) for s, c in own[:3]]
        runs = []
        for s, c in own:
            if runs and runs[-1][1] == s - 1 and _alike(c, runs[-1][2]):
                runs[-1][1:] = [s, c]
            else:
                runs.append([s, s, c])
        expected[f] = [(a, b) for a, b, _ in runs]
    df = spark.createDataFrame(rows, "file_id long, seq long, start_ms long, end_ms long, content string")
    for least in (1, 2):
        found = {f: [] for f in expected}
        for r in collapse_runs(df, block=8, min_events=least).orderBy("file_id", "first_seq").collect():
            found[r.file_id].append((r.first_seq, r.last_seq))
        assert found == {f: [x for x in own if x[1] - x[0] + 1 >= least] for f, own in expected.items()}
    assert collapse_runs(df.limit(0)).collect() == []
