"""A PySpark engine for text corpora, retrieval and session analytics.

``operators`` holds DataFrame transforms, ``functions`` column expressions,
``sources`` readers and writers, ``plans`` the registered queries with their
SQL counterparts, ``streaming`` the stateful operators, and ``llm`` the
training-data operators (a separate subpackage which nothing here imports).
"""

__version__ = "0.1.0"
