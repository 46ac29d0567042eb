"""quillstone: retrieval and text analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; the ``llm``
subpackage holds the training-data operators and nothing outside it imports it.
"""
