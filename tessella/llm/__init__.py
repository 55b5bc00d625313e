"""Training-data operators: one module per operator, each with its thin query.

Nothing outside this subpackage (but the top-level pipeline and the guarded
entry module) imports it.
"""
