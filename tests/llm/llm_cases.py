"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

EXTRA = "extra STRING, component_id STRING, score STRING, ids STRING, line STRING, n_words STRING, _text STRING, n STRING"
DOCUMENTS = f"doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, {EXTRA}"


def _prose(rng, count):
    return " ".join(rng.choice(["river", "stone", "Cloud", "été", "ümlaut", "low", "7", "it's", "a,b"]) + str(rng.randrange(60)) for _ in range(count))


def texts():
    rng = random.Random(5)
    base = _prose(rng, 60)
    words = base.split(" ")
    near = " ".join([*words[:30], "changed", *words[31:]])
    found = [
        None, "", " \n ", "one", "One", "three little words", base, base, near, base.upper(), _prose(rng, 40),
        "line a b c d e f g\nline a b c d e f g\n\nother line of some length here", "x" * 5000, "\x00 \x02 odd\x1cbytes   here",
        "Two  spaces\n\n\nand lines \n", "<|endoftext|> <|startoftext|>", "日本語 のテキスト です。", "é å", _prose(rng, 4000),
    ]
    return found + [_prose(rng, rng.randrange(1, 90)) for _ in range(25)]


def documents(spark):
    """Ids 0, 1, ...; one null id, one repeated row."""
    rows = [(k, text, "en", f"s{k % 3}", len(text or ""), *["x"] * 8) for k, text in enumerate(texts())]
    rows += [rows[6], (None, texts()[10], "en", "s", 1, *["x"] * 8)]
    return spark.createDataFrame(rows, DOCUMENTS)


def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
