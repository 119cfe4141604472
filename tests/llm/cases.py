"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeats, clashing names."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, kept string, digest string, n string, level string, row string"


def words(rng, n, kind=400):
    return " ".join(f"w{rng.randrange(kind)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def documents(spark, seed=5):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 300)) for _ in range(40)]
    long = "\n".join(words(rng, 60) for _ in range(200))
    texts = [*base, base[0], base[0], base[3].upper(), None, None, "", " \t\n\x0b\x0c\r ", "one", "one two three four", "ONE two three four", long, long + " end"]
    for _ in range(12):  # near copies: one word changed
        w = base[5].split(" ") if len(base[5].split(" ")) > 60 else words(rng, 150).split(" ")
        base[5] = " ".join(w)
        w = list(w)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["\n".join([base[1][:70], "", base[2][:90], base[1][:70], " ", f"line {i} of a page that repeats with a number"]) for i in range(6)]
    texts += ["🙂é漢字\x85 \x1f x" * 3, "a <|endoftext|> b", "x" * 5000, "'s 'S it's   \n\n  end  "]
    rows = [(i * 3 - 7, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["src0"] * 5 + ["src1", "ß", "Z", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[7], "en", "src0", 1), (None, None, None, None, None), (2**62 + 1, base[8], "fr", "src1", 2)]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "s", "t", "k", "d", "n", "l", "r") for r in rows], DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df):
    """doc_id and text of each row."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
