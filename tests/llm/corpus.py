"""Small tables with the odd rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t long, k string, label string"


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 9)))
    line = lambda n=9: " ".join(word() for _ in range(n)) + rng.choice([".", "!", ",", ""])
    base = ["\n".join(line() for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    passage = line(30)
    texts = [None, "", "   \n\t ", "a", "Don't  we'LL 's 12 345", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "日本語 テスト é ﬁ İ Σς \x85 \xa0 \x1c x", line(4000)]
    texts += base + base[:6] + [b.replace("a", "A", 1) for b in base[:8]] + [b + " tail " + word() for b in base[8:14]]
    texts += [f"{line()}\n{passage}\n{line()}" for _ in range(5)] + ["the same words here again and again " * 8] * 3
    rows = [(i, x, "en", "s", len(x or ""), i % 3, 7, "k", "l") for i, x in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, base[0], None, None, None, None, None, None, None), (10, "another text of id ten " + line(), None, None, None, None, None, None, None)]


def table(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
