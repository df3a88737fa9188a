"""Small documents with every edge case: nulls, empty and long texts, copies, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, gone string, score double, seg int, row_number int, _key int"
EN = "the and of ing tion er es in on re at th ed nd ha hi st en ly".split()
FR = "le la des eau oux que ment ré è ou tre elle ch ion ais eur".split()


def prose(rng: random.Random, syllables: list[str], n: int) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + (rng.random() < 0.1) * rng.choice([".", ",", ".\n"]) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append([i, prose(rng, EN if lang == "en" else FR, rng.randint(5, 150)), lang])
    passage = prose(rng, EN, 60)
    for i in (3, 8, 20):
        rows[i][1] += " " + passage + " tail"
    rows[30][1] = rows[4][1]
    rows[31][1] = rows[4][1]
    rows[32][1] = rows[5][1].replace(" ", "  ", 1)
    rows += [
        [60, None, "en"],
        [61, "", "en"],
        [62, "   \n ", None],
        [63, "12 34 !!", "fr"],
        [64, "a", None],
        [65, prose(rng, EN, 9000) + " " + passage, "en"],
        [66, "ab" * 300, "en"],
        [67, "Ünïcödé “quotes” <|endoftext|> <|im_end|> \\ <\\| tab\tx  end ", "fr"],
        [68, "été ΑΣ ﬁ ẞ ſ İ 漢字かな 🙂", None],
        [None, passage, None],
    ]
    rows.append(rows[2])  # a repeated row
    return [(d, t, lang, None if (d or 0) % 7 == 0 else f"src{(d or 0) % 3}", None if t is None else len(t), 1, "x", 0.5, 2, 3, 4) for d, t, lang in rows]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts() -> dict:
    """Text of each doc_id, null as empty."""
    return {r[0]: r[1] or "" for r in documents()}
