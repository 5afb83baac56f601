"""Small inputs that every operator has to stand."""

TEXTS = [
    None, "", " ", "\n\n", "a", "word", "it's  two\tblanks\r\n", "Ünïcödé ẞ ΑΣ İi ß 漢字かな 😀👍🏽", "<|endoftext|> </s>[INST] ok [/INST]", "x" * 700, "ab" * 900,
    "same text of two rows here", "same text of two rows here", "1234567890 !!! ???", "é ́x  nbsp em \x1c\x1dsep", "the cat sat on the mat. " * 400,
]


def documents(spark, texts=None, ids=None, extra=""):
    texts = TEXTS if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def store(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
