"""Rows that every operator must take."""

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, "one"),
    (4, "one"),  # a repeated row
    (None, "a text without an id"),
    (6, "x" * 200_000),
    (7, "word " * 40_000),
    (8, "naïve café \U0001f600 emoji and a \x00 byte"),
    (9, "A B C d e f"),
    (10, "a b c D E F"),
]
