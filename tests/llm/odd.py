"""A small table with what each operator has to bear."""

LOW = -(1 << 63)

TEXTS = [
    (1, "One two three. Four five six seven eight nine ten eleven twelve thirteen.\nA line of its own."),
    (2, None), (3, ""), (4, " \t\n"), (5, "12 34 !!"), (6, "a"), (6, "a"), (7, "word " * 3000), (None, "no id here at all"), (None, "another one"),
    (9, "One two three. Four five six seven eight nine ten eleven twelve thirteen.\nA line of its own."), (10, "été ß 日本語 🙂"),
    (11, "x" * 20000), (12, " ".join(f"w{k}" for k in range(60))), (13, "tail " + " ".join(f"w{k}" for k in range(60))),
]


def docs(spark, rows=TEXTS):
    """The table, with columns whose names the operators use themselves."""
    more = [(i, t, i, "v", 1, 2, 3, "x") for i, t in rows]
    names = "doc_id bigint, text string, id bigint, version string, bin int, next int, extra int, lang string"
    return spark.createDataFrame(more, names)
