"""Documents with every awkward case: nulls, empties, long texts, ties, repeats, columns whose names clash."""

import random

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ung der keit ü zu ber ge ö".split(), "fr": "eau ré ment oi tion qu è le aux ch".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key long, id long, th long, component long, pos int, sig string"


def words(r, n, lang="en"):
    return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def documents(seed=1, n=60):
    r = random.Random(seed)
    out = []
    base = [words(r, r.randint(60, 200)) for _ in range(6)]
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        kind = i % 6
        if kind < 2:
            w = list(base[i % len(base)])
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words(r, 1))
            text = " ".join(w)
        elif kind == 2:
            a = base[r.randrange(len(base))]
            text = " ".join(words(r, 30, lang) + a[:40] + words(r, 30, lang))
        else:
            text = "\n".join(" ".join(words(r, r.randint(1, 12), lang)) for _ in range(r.randint(1, 15)))
        out.append((i, text, lang, f"s{i % 3}"))
    out += [
        (100, None, "en", None), (101, "", None, "s0"), (102, " \t\n ", "en", "s0"), (103, "one two", "en", "s1"), (104, "one two", None, None), (105, "One  TWO", "en", "s1"),
        (106, " ".join(words(r, 30_000)), "en", "s2"), (107, "a" * 70_000, "en", "s2"), (108, "naïve café ☃ 中文字 ﬁ 😀 <|endoftext|> don't", "fr", "s2"),
        (109, "the the the " * 200, "en", "s0"), (110, out[0][1], "en", "s0"), (110, out[0][1], "en", "s0"), (111, "#$% ## && " * 80, "en", "s1"), (112, "123 456 .", "en", "s1"),
    ]
    return [(*row, len(row[1] or ""), 7, 7, 7, 7, 7, 7, "x") for row in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nulls(spark):
    return spark.createDataFrame([(None, "some words that have no id at all", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
