"""Column expressions: noise, model, integer weights and slots."""
