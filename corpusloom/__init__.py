"""Document retrieval on Spark: parse, chunk, embed, index, search, answer and score, as DataFrame operators."""
