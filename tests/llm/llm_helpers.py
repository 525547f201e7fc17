DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null and empty texts, null ids and columns, ties, repeated rows, line ends, marks, other scripts
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "one two three", "en", None, 13),
    (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13), (5, "One two\x0bthree", "de", "b", 13),
    (6, "é日本 😀 ▁x  y\r\nz <|endoftext|> <s> \x00 end", "fr", "b", 40),
]
