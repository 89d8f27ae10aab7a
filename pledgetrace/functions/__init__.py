"""Column expressions: text, money, passage rules, vectors."""
