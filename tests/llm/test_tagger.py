"""The character tagger: gradients, learning, and what it adds to the rules."""

import numpy as np

from plumewatch.llm import pii
from plumewatch.llm.tagger import Tagger, encode


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger(3, hidden=4, width=3)
    x, y = rng.integers(0, 132, (3, 6)), rng.integers(0, 3, (3, 6))
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.gradients(x, y)
    for k, v in tagger.p.items():
        flat = v.reshape(-1)
        places = [x[0, 0] * 3, x[1, 2] * 3 + 1] if k == "embed" else rng.integers(0, len(flat), 4)
        for i in places:
            held = flat[i]
            flat[i] = held + 1e-2
            up = tagger.gradients(x, y)[0]
            flat[i] = held - 1e-2
            down = tagger.gradients(x, y)[0]
            flat[i] = held
            assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 5e-3 + 0.02 * abs(g[k].reshape(-1)[i])


def test_learns_spans_and_finds_a_phone_without_plus(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        n = rng.integers(0, 10, 12)
        rows.append((f"call +1 ({n[0]}1{n[1]}) 55{n[2]}-{n[3]}{n[4]}{n[5]}1 now or w{i}@m{n[6]}.example.com "
                     f"of year {n[7]}{n[8]} in 1{n[9]}.{n[10]}.{n[11]}.7",))
    df = spark.createDataFrame(rows, "text string")
    tagger = pii.train(df, steps=200)
    alone = pii.added_spans(tagger, [r[0] for r in rows[:40]], [[] for _ in rows[:40]])
    want = [set(pii.base_spans(r[0])) for r in rows[:40]]
    hit = sum(len(w & set(a)) for w, a in zip(want, alone))
    assert hit >= 0.8 * sum(map(len, want))
    # with base spans in place nothing is added on top of them
    again = pii.added_spans(tagger, [r[0] for r in rows[:40]], [sorted(w) for w in want])
    assert all(not any(a < d and c < b for _, a, b in new for _, c, d in old)
               for new, old in zip(again, want))


def test_no_spans_no_tagger(spark):
    assert pii.train(spark.createDataFrame([("no numbers",), (None,), ("",)], "text string")) is None


def test_reconcile_joins_pieces_and_settles_conflicts():
    text = "x" * 10 + "+1 319 555 5132" + "y" * 10
    found = pii.reconcile(text, [], [(3, 10, 20, 0.95), (3, 15, 25, 0.97), (2, 12, 20, 0.99)])
    assert found == [(3, 10, 25)]
    assert pii.reconcile(text, [(3, 9, 12)], [(3, 10, 25, 0.99)]) == []


def test_redaction_and_long_texts_take_linear_time(spark):
    text = "a" * 200_000 + "@" + "1" * 200_000 + "@b.c" + "+1" * 50_000 + "1.1." * 50_000
    assert pii.base_spans(text)
    df = spark.createDataFrame([(1, "to a.b@c.de from 10.0.0.1", "k")], "id long, text string, pii string")
    row = pii.find(df, None, clean="text").first()
    assert row.text == "to [EMAIL] from [IP]" and len(row.pii) == 2 and row.id == 1


def test_encode_classes():
    assert encode("aé٣☃").tolist() == [97, 128, 129, 130]
