"""Documents that trip careless operators, with columns whose names the operators use themselves."""

LOW_TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_chars long, id long, tag long, `group` int, bucket long, kept boolean, rep long, n long, row_hash long, key long, `first` long"

PASSAGE = "Rend, thth, that. At reble is thanenha ananes thwh reaton thing, haor inwh thtiea is retion as the a anst a ertionha"
BASE = " ".join(f"wört{i} Thing{i % 7} the" for i in range(60))


def nasty_texts():
    near = BASE.replace("wört30", "changed")
    return [
        (1, BASE),
        (2, BASE.upper()),  # ASCII case only: equal but for ö
        (3, near),
        (3, near),  # repeated row
        (3, "Another text under the same id, quite short."),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "one two"),
        (9, "ONE\x0btwo\x0c"),
        (None, BASE),
        (None, None),
        (10, f"Intro line.\n{PASSAGE}\nOutro."),
        (11, f"Something else entirely; {PASSAGE} and more after it"),
        (12, PASSAGE),
        (13, "a" * 700),
        (14, "b" + "a" * 300),
        (15, "ab" * 200),
        (16, BASE * 40),
        (17, "é" * 60 + "漢字" * 40),
        (18, "ü" + "é" * 59),
        (19, "Released under the MIT License.\nreleased  under the MIT licence\n\nAll rights reserved.\nx"),
        (20, "the same line\nthe  SAME line\nother\nthe same line"),
        (21, "\U0001f600 <|endoftext|>  x  y 　z"),
        (22, "... ### !!! | | |"),
    ]


def frame(spark, rows):
    data = [(i, t, "en", len(t or ""), 5, 5, 5, 5, True, 5, 5, 5, 5, 5) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)
