"""Small tables with what real ones hold: nulls, empty and long texts, copies, repeated rows, clashing extra columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["words", "n", "key", "component", "rank", "block", "part", "run", "label", "score", "_training", "group", "start", "_text_mark"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(r, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[r.randrange(10)]}w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    base = [prose(r, n) for n in (60, 80, 120, 200, 300, 55, 70, 90)]
    long = prose(r, 20_000, 5_000)
    texts = [*base, base[2], base[2], base[3] + " tail", "Head " + base[3], base[4].upper(), long, long + " end",
             "", None, " \t\n ", "one", "One", "two words", "TWO  words", "three words here", "日本語 テキスト x 😀 ñ", "a\x1cb c  \n\n\n d",
             "same line here\n" * 30, "x# $ % & | <y>\n" * 20, "w" * 5_000]
    near = base[4].split(" ")
    for i in range(12):  # a group of near copies, each with an edit of its own
        w = list(near)
        w[20 * i + 5] = f"edit{i}"
        texts.append(" ".join(w))
    made = [(i * 5, t, ["en", "de", None][i % 3], ["src0", "src0", "src1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    made += [made[0], made[8], (None, base[5], "en", None, None), (None, None, None, None, None)]
    return made


def docs(spark, data=None, extra=True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if extra:
        for c in EXTRA:
            df = df.withColumn(c, df["doc_id"] % 3)
    return df


def empty(spark):
    return docs(spark, [])
