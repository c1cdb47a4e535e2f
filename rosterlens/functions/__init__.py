"""Column functions: text, urls, arrays, and the fixed word lists."""
