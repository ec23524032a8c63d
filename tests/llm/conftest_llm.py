"""Rows that every operator must bear."""

#: Nulls in every column, empty and blank texts, ties and repeated rows, one long text.
ODD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \n\t ", None, "b"),
    (None, "null id", "de", "b"),
    (6, "1234 5678 ...", "fr", "b"),
    (7, "lange Wörter über Grenzen hinweg " * 3000, "de", "a"),
    (8, "x", "zz", "c"),
]
