"""Small tables with every edge: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = ["the", "of", "Tiger", "né", "über", "alpha", "x1", "漢字", "stop.", "and", "river", "stone", "cloud", "amber"]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(5, 90))) for _ in range(n)]
    rows = list(enumerate(base))
    rows += [(n + i, base[i]) for i in range(10)]  # exact copies
    for i in range(10):  # near copies
        w = base[i + 10].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((n + 10 + i, " ".join(w)))
    passage = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(70))
    rows += [(n + 20 + i, f"{base[i][:50]} {passage} {base[i + 1][:60]}") for i in range(8)]
    rows += [(n + 30, None), (n + 31, ""), (n + 32, "   \n\t "), (n + 33, "one two"), (n + 34, "one two"), (n + 35, "a" * 300), (n + 36, "b" * 7 + "a" * 300), (n + 37, "ab" * 4000), (n + 38, "x\x00y \x00 z")]
    r.shuffle(rows)
    return rows


def frame(spark, rows, **more):
    """doc_id, text, and columns whose names operators might use themselves."""
    kind = "doc_id long, text string, spans string, row int, block long, ids string, lang string, source string, n_chars long"
    full = [(i, t, "s", 1, 2, "i", None if k % 5 == 0 else "en", None if k % 7 == 0 else f"h{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, kind).repartition(3)
