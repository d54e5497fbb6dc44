"""Column expressions: text, URLs, similarity. No UDF in here."""
