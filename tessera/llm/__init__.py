"""Training-data operators: ten stand-alone corpus operators built on Spark.

Nothing outside this package imports it; ``tessera.llm.queries`` is its only
entry point for the driver contract.
"""
