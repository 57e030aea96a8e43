"""Column expressions: text, numbers, arrays and maps, biological sequences. Null in, null out unless said otherwise."""
