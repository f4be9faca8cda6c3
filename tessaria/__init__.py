"""Evidence and sequence analytics on Spark: nested, ordered, partially unknown records."""
