"""Column expressions: text, tag codecs and maps with defaults."""
