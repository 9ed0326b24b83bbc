"""Training-data operators: ten text operators and the corpus pipeline.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Query
modules are ``selecta.llm.q_*``; :func:`register` collects their queries.
"""
