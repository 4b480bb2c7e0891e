import pytest

#: Texts that every operator must take: null, empty, blank, short, odd letters, marks.
ODD = [None, "", " \n\t ", "word", "a b", "ÉÀ ß́ \U0001f600 ǅ", "same text here for all of us today", "same text here for all of us today", "\n\n\n", "<|im_end|> 4111 1111 1111 1111 a@b.c"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "x", "y") for i, t in enumerate(ODD)]
    rows += [(7, ODD[7], "en", "s", 0, "x", "y"), (None, "no key", None, None, None, None, None)]
    rows.append((100, "lorem ipsum dolor " * 20_000, "fr", "s", 0, "x", "y"))
    # columns with names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t string, line string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
