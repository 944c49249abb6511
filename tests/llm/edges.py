"""A table of documents with every awkward case, and an empty one."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "place long, spans string, score double, key string, fp long, k string, component string")
LONG = "word " * 30_000 + "x" * 50_000 + " 1" * 3_000 + "a@" * 2_000


def rows():
    texts = [None, "", " \n\t ", "one", "Same text\nof two lines here.", "Same text\nof two lines here.", LONG,
             "mail bob.42@mail.example.com or +1 (555) 555-0199", "naïve café 日本語 🎉 \x00\x1f\x85"]
    out = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 0.5, "k", 1, "z", "c") for i, t in enumerate(texts)]
    out.append(out[4])                                  # a repeated row
    out.append((None, "text of a row without an id", *[None] * 10))
    out.append((None, None, *[None] * 10))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
