"""Documents with every oddity the operators must take."""

import random


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies and shared passages."""
    rng = random.Random(5)
    base = words(rng, 120, 5000)
    passage = words(rng, 60, 9000)
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one two", 5: "One  TWO", 6: "one two", 7: "Straße É", 8: "STRASSE É",
        9: base, 10: base.upper(), 11: base + " tail", 12: "x " + base, 13: base.replace(" ", "\n", 3),
        14: words(rng, 90) + " " + passage + " " + words(rng, 40), 15: passage + " " + words(rng, 80), 16: words(rng, 70) + "\n" + passage,
        17: words(rng, 30_000, 2000), 18: "same " * 60, 19: "a\x0bb\x0cc\xa0d e", 20: "中文 文本 <s> <|endoftext|> ▁x  y ", 21: "\x00null byte",
    }
    rows = [(i, t, "abc"[i % 3] if i % 5 else None) for i, t in texts.items()]
    rows += [(9, base, "a"), (9, base, "a"), (None, base, None), (None, None, None), (30, "one two", "z")]
    for i in range(40, 70):  # a hot group of near copies and of one line
        own = base.split()
        own[rng.randrange(len(own))] = f"changed{i}"
        rows.append((i, " ".join(own) + "\n shared LINE \n" + f"end {i}", "a"))
    for i in range(70, 90):
        rows.append((i, words(rng, rng.randrange(1, 300)), rng.choice("abcd")))
    return rows
