"""corpusprep: language-model corpus preparation as plain Spark DataFrame jobs.

Every public operator is a function DataFrame -> DataFrame (or Column -> Column)
that leaves planning to Catalyst. Modules:

* ``sources``   - readers and writers (splits, JSONL, text lines, vocab, blocks)
* ``functions`` - column expressions (whitespace, metaspace, formats, array ops)
* ``operators`` - table jobs (order/rank, splits, articles, message trees,
                  vocabularies, encoding, packing, statistics, evaluation)
* ``plans``     - the registered queries over the driver tables and their SQL
* ``streaming`` - resumable ingest and running counters (Structured Streaming)
"""

__version__ = "0.1.0"
