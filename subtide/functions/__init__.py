"""Column functions: times, text rules, references and encodings."""
