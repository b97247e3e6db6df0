"""Small tables that hold nulls, empty and very long texts, ties, repeats and columns with clashing names."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, length string, __text string"
LONG = "alpha beta gamma delta " * 20_000


def documents(spark, rows=None):
    rows = rows if rows is not None else [
        (0, "the quick brown fox jumps over the lazy dog", "en", "b"),
        (1, "The Quick brown fox jumps over the lazy dog", "en", "b"),
        (1, "The Quick brown fox jumps over the lazy dog", "en", "b"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n ", "en", "a"),
        (5, LONG, "de", "a"),
        (None, "no id here at all", "en", "a"),
        (None, None, None, None),
        (7, "ein zwei\x00 drei éß 你好 🙂", "de", "c"),
        (8, "one", "en", "c"),
        (9, "one two", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, 1.0, "x", "y", "z") for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def water_fill(sizes, weights, budget, most):
    """Targets that share the budget by weight, none above `most` times its size, round by round: those that are full keep that,
    and the others share what is left. A budget over all limits gives every source its limit."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], budget
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = most * sizes[i]
        left = max(0.0, left - sum(most * sizes[i] for i in full))
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return target
