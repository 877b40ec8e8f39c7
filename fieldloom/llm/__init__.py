"""Training-data operators: one module per operator, registered in ``fieldloom.llm.queries``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
