"""Claims-integrity operators: DataFrames in, one lazy DataFrame out.

Every operator covers all providers in one job. ``providers`` (names or a
DataFrame) narrows the answer without changing the peer groups it is measured
against.
"""
