"""Training-data operators: language id, near/exact dedup, packing, token
counts, decontamination, toxicity and secret scans.

Nothing else in the library imports this package; its queries are listed in
``orrery.llm.queries``.
"""
