"""Training-data operators: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when the subpackage is present.
"""
