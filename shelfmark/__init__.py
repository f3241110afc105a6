"""shelfmark: a Spark-native engine for file catalogues, text structure and vector retrieval.

Relational work is expressed as DataFrame and Column operations; Arrow-batched
Python runs only where a document, a vector block or a string automaton needs it.
The subpackage ``llm`` holds the training-data operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
