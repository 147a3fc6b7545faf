"""opinia — review analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for pure expressions) and runs on the executors.  Sub-packages:

* ``opinia.sources``   — tolerant CSV read/write, unions, slices, model store
* ``opinia.functions`` — column expressions (text, labels, literal parsing)
* ``opinia.operators`` — relational operators and ML estimators
* ``opinia.plans``     — composed jobs and the query catalogue
* ``opinia.streaming`` — Structured Streaming variants of the batch jobs
"""

__version__ = "0.1.0"
