"""The exact evaluator in plain Python: it defines what every faster plan has to agree with."""
