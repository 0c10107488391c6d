"""restatement_pairs against difflib over all pairs of a conversation."""

from __future__ import annotations

import difflib
import itertools
import random
import re
from collections import Counter, defaultdict

from caseflow.plans import catalogue


def statement(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip(" ")


def test_every_earlier_message_is_compared(spark, tmp_path):
    rng = random.Random(4)
    own = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "to", "of"]) + str(rng.randrange(9)) for _ in range(rng.choice([3, 12, 30]))) for _ in range(12)]
    rows = []
    for c in [*range(8), None]:
        for turn in range(30 if c == 3 else 8):
            text = rng.choice(own)
            if rng.random() < 0.5:
                i = rng.randrange(len(text))
                text = text[:i] + "Q" * rng.choice([1, 1, 4]) + text[i + 1 :]
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(50, 0, "user", "same"), (50, 1, "assistant", "other"), (50, 2, "user", "Same!"), (50, 3, "assistant", None), (50, 4, "user", "..."), (50, 5, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, turn, _, text in rows:
        if text is not None:
            by[c].append((turn, statement(text)))
    want = Counter((c, b, a) for c, m in by.items() for (a, x), (b, y) in itertools.combinations(m, 2) if difflib.SequenceMatcher(None, y, x, autojunk=False).ratio() >= 0.93)
    got = Counter(map(tuple, catalogue.queries()["restatement_pairs"](spark, str(tmp_path)).collect()))
    assert got == want and (50, 2, 0) in got and sum(b - a > 1 for _, b, a in got) > 20
